"""Shards of near documents: a Hilbert curve over metadata, cut into runs of equal counts.

Each dimension is quantised to ``2 ** BITS`` cells: sizes on a log scale, ids evenly between their
least and greatest, names by hash. The cells' place on the Hilbert curve orders the documents, ties
by id and text. The ranks are cut into runs, so the law is ``rows``: shard counts differ by one at
most. Each shard's least and greatest cells make a manifest that prunes whole shards for filters on
any of the dimensions. DataFrame functions only.

Defined results: ids are numbers of any range, or texts, whose first bytes are their cell; a null name is a
cell of its own, a null id or size counts as the lowest; null texts have size 1; repeated rows are placed next to each other; an empty table gives an empty plan. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidegauge.llm.shared import let, written

BITS = 8
SHARDS = 8


def name_cell(name: Column, bits: int = BITS) -> Column:
    return F.xxhash64(F.coalesce(name.cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Eight cells for each doubling of a size, up to the last cell."""
    return F.least(F.floor(8 * F.log2(1 + F.coalesce(size, F.lit(0)))), F.lit((1 << bits) - 1)).cast("int")


def id_cell(number: Column, low: Column, high: Column, bits: int = BITS) -> Column:
    """Place of a number between the least and the greatest; differences of any two longs fit a decimal."""
    wide = lambda x: x.cast("decimal(30,8)")
    share = (wide(number) - wide(low)).cast("double") / ((wide(high) - wide(low)).cast("double") + 1)
    return F.least(F.coalesce(F.floor(share * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def text_cell(text: Column, bits: int = BITS) -> Column:
    """The first bits of a text's first two bytes, so that cells follow the order of texts."""
    head = F.rpad(F.hex(F.substring(text.cast("string").cast("binary"), 1, 2)), 4, "0")
    return F.coalesce(F.shiftright(F.conv(head, 16, 10).cast("int"), 16 - bits), F.lit(0))


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve through a grid of ``2 ** bits`` cells a side (Skilling's transform)."""
    n, top = len(cells), 1 << (bits - 1)
    steps = F.array(*[F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, s: Column) -> Column:
        p = s["q"] - 1
        high = F.get(x, s["i"]).bitwiseAND(s["q"]) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, s["i"])).bitwiseAND(p)
        moved = lambda v, j: F.when(high, F.when(j == 0, v.bitwiseXOR(p)).otherwise(v)).when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v)
        return F.transform(x, moved)

    def gray(x: Column) -> Column:
        return F.transform(x, lambda v, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

    def last(x: Column) -> Column:
        flips = F.array(*[F.lit(1 << q) for q in range(bits - 1, 0, -1)])
        turn = F.aggregate(flips, F.lit(0), lambda t, q: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return let(turn, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def joined(x: Column) -> Column:
        masks = F.array(*[F.lit(1 << q) for q in range(bits - 1, -1, -1)])
        bit = lambda total, v, q: 2 * total + F.when(v.bitwiseAND(q) != 0, 1).otherwise(0)
        return F.aggregate(masks, F.lit(0).cast("long"), lambda total, q: F.aggregate(x, total, lambda t, v: bit(t, v, q)))

    if top * n == 0 or bits * n > 62:
        raise ValueError("the index must fit 62 bits")
    start = F.array(*[c.cast("int") for c in cells])
    return let(F.aggregate(steps, start, undo), lambda x: let(gray(x), lambda y: let(last(y), joined)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the four cells and the curve index of each document."""
    raw = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "lang", "source",
    )
    numeric = isinstance(docs.schema["doc_id"].dataType, NumericType)
    if numeric:
        # One row with the least and greatest id meets every document.
        raw = raw.crossJoin(F.broadcast(docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))))
    cells = raw.select(
        "doc_id", "size", "text_crc32", name_cell(F.col("lang")).alias("c_lang"), name_cell(F.col("source")).alias("c_source"),
        size_cell(F.col("size")).alias("c_size"), (id_cell(F.col("doc_id"), F.col("low"), F.col("high")) if numeric else text_cell(F.col("doc_id"))).alias("c_id"),
    )
    return cells.withColumn("curve", hilbert_index([F.col(c) for c in CELLS]))


CELLS = ("c_lang", "c_source", "c_size", "c_id")


def shard_plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`measured` with shard and slot: ranks along the curve, cut into runs of equal counts.

    Rows are dealt by range and numbered within their partition; the partitions' counts, one row
    for each, give the offsets.
    """
    dealt = measured(docs).repartitionByRange("curve", "doc_id", "text_crc32").sortWithinPartitions("curve", "doc_id", "text_crc32", "size")
    rows = written(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    # One row for each shuffle partition.
    ranked = rows.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = ranked.withColumn("shard", F.expr(f"rank * {shards} div total").cast("int"))
    return placed.withColumn("slot", F.expr(f"rank - (shard * total + {shards - 1}) div {shards}")).drop("at", "part", "before", "total", "rank")


def manifest(plan: DataFrame) -> DataFrame:
    """One row per shard: rows, bytes, and the least and greatest cell of each dimension."""
    ranges = [f(c).alias(f"{name}_{c}") for c in CELLS for f, name in ((F.min, "low"), (F.max, "high"))]
    return plan.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)


def prune(shards: DataFrame, **cells: tuple[Column, Column]) -> DataFrame:
    """Shards of a manifest that can hold rows with each given dimension between two cells."""
    for name, (low, high) in cells.items():
        shards = shards.where((F.col(f"low_{name}") <= high) & (F.col(f"high_{name}") >= low))
    return shards.select("shard")


def write_shards(docs: DataFrame, plan: DataFrame, path: str, column: str = "shard_no") -> None:
    """Write the documents into one folder per shard, in slot order; ``column`` names the folders, with ``_`` behind it where the documents have such a column.

    Rows are matched by doc_id and text checksum; a repeated row is written as often as it occurs.
    """
    while column in docs.columns:
        column += "_"
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    places = plan.groupBy(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc")).agg(F.min(F.struct("shard", "slot")).alias("at"))
    placed = keyed.join(places, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_crc32") == F.col("crc")))
    ordered = placed.repartitionByRange("at").sortWithinPartitions("at")
    ordered.select("row.*", F.col("at.shard").alias(column)).write.partitionBy(column).parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    return shard_plan(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
