"""Near-duplicate groups by tensored MinHash banding, confirmed on whole shingle sets.

A document has two small collections of ``m`` tuples of ``k`` minhashes. A table key is a pair
(tuple i of the first, tuple j of the second): ``m * m`` tables of ``2k`` hashes from ``2mk``
minhash functions. A pair of Jaccard similarity J shares a table with probability
``(1 - (1 - J^k)^m)^2``: 0.9999 at J = 0.75 for m = 18, k = 3.

Documents with equal sets form one class, and only classes are compared. Tuples that no other class
has are dropped before pairs of tuples are formed. In each bucket every class meets the bucket's
pivot, the class with the most tables; each class is verified with the pivot that it shares most
tables with, and these links are followed to their roots. Then the pairs of classes that share a
table and still have different roots are verified too, so no candidate pair between components is
left out. Before that, a parity bitmap of 1024 bits bounds a pair's symmetric difference from below,
so that join gives only pairs that can be links.

Defined results: null texts, and texts without words, have no shingles and are linked with nothing;
texts of fewer than five words have one shingle. Repeated rows get equal rows. Rows that share a
doc_id are judged by their own text. A null doc_id is never the smallest; a component of only such
rows has a null id and keeps all of them. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bytewords import NON_SPACE, Words, mix, row_blocks, run_codes, run_hashes, run_starts, stream, text_bytes
from tidegauge.llm.components import components, tops
from tidegauge.llm.shared import met_by_many, written

SHINGLE = 5
TUPLES, WIDTH = 18, 3
MARKS = 16
#: Members of a bucket, or of a pivot, that one task compares at once.
MEET = 2000
PERCENT = 75
#: Bytes of text whose words lie in arrays at once.
STEP_BYTES = 1 << 20


def _places(words: Words, n: int):
    """(size, texts, words) of all shingles: every ``n`` words in a row, or the whole of a shorter text."""
    starts, rows = run_starts(words, n), words.rows()
    yield n, rows[starts], starts
    for size in range(1, n):
        short = np.flatnonzero(words.counts == size)
        if len(short):
            yield size, short, words.first[short]


def _distinct(at: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places of one of each (text, value), in their order."""
    order = np.argsort(found, kind="quicksort")
    order = order[np.argsort(at[order], kind="stable")]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[order][1:] != at[order][:-1]) | (found[order][1:] != found[order][:-1])
    return order[new]


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash: (text, hash, a second hash)."""
    lanes, places = words.lanes(), list(_places(words, n))
    at = np.concatenate([rows for _, rows, _ in places])
    both = []
    for seed in (1, 2):
        hashes = words.hashes(seed, lanes)
        both.append(np.concatenate([run_hashes(hashes, size)[starts] for size, _, starts in places]))
    one = _distinct(at, both[0])
    return at[one], both[0][one], both[1][one]


def exact_shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as numbers that are equal only for the same words: (text, number)."""
    which, places = words.numbers()[0], list(_places(words, n))
    at = np.concatenate([rows for _, rows, _ in places])
    found = np.concatenate([run_codes(which, size)[starts] * (n + 1) + size for size, _, starts in places])
    one = _distinct(at, found)
    return at[one], found[one]


def _signature_rows(data, offsets, m: int, k: int):
    words = Words(data, offsets, NON_SPACE)
    at, found, second = shingles(words)
    n_texts = len(offsets) - 1
    sizes = np.bincount(at, minlength=n_texts)
    full = np.flatnonzero(sizes)
    cuts = np.concatenate(([0], np.cumsum(sizes[full])))[:-1]
    odd = stream(3, 2 * m * k) | np.uint64(1)
    salt = stream(4, 2 * m * k + 2)
    digest = [np.zeros(n_texts, np.uint64), np.zeros(n_texts, np.uint64)]
    bands = np.zeros((n_texts, 2 * m), np.uint64)
    if len(full):
        for i, values in enumerate((found, second)):
            digest[i][full] = np.add.reduceat(mix(values ^ salt[-1 - i]), cuts)
        for band in range(2 * m):
            key = np.full(len(full), band + 1, np.uint64)
            for j in range(band * k, band * k + k):
                key = mix(key + np.minimum.reduceat((found ^ salt[j]) * odd[j], cuts))
            bands[full, band] = (key & ~np.uint64(1)) | np.uint64(band >= m)
    return sizes, digest, bands, _parities(at, found, n_texts)


def _parities(at: np.ndarray, found: np.ndarray, n_texts: int) -> np.ndarray:
    """Bitmaps in which each shingle flips one bit: those of two sets differ in no more bits than the sets in shingles."""
    width = 64 * MARKS
    odd = np.bincount(at * width + (found % np.uint64(width)).astype(np.int64), minlength=n_texts * width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).reshape(n_texts, MARKS)


def signatures(docs: DataFrame, m: int = TUPLES, k: int = WIDTH) -> DataFrame:
    """doc_id, text key, set size, two digests of the set, 2m band keys (the last bit tells the collection) and the parity bitmap."""

    def sign(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for low, high in row_blocks(offsets, STEP_BYTES):
                sizes, (d1, d2), bands, marks = _signature_rows(data[offsets[low] : offsets[high]], offsets[low : high + 1], m, k)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * 2 * m), pa.array(bands.reshape(-1).view(np.int64)))
                marked = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * MARKS), pa.array(marks.reshape(-1)))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists, marked],
                    ["doc_id", "text_key", "n", "d1", "d2", "bands", "marks"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        sign, f"doc_id {id_type}, text_key long, n long, d1 long, d2 long, bands array<long>, marks array<long>"
    )


def _shared_counts(a: pa.Array, b: pa.Array) -> list[np.ndarray]:
    """Set sizes of both texts of each row, and of their intersection, with words compared by bytes."""
    n = len(a)
    (one, first), (two, second) = text_bytes(a), text_bytes(b)
    words = Words(np.concatenate((one, two)), np.concatenate((first, second[1:] + first[-1])), NON_SPACE)
    at, found = exact_shingles(words)
    sizes = np.bincount(at, minlength=2 * n)
    order = np.lexsort((found, at % n))
    at, found = at[order] % n, found[order]
    same = (at[1:] == at[:-1]) & (found[1:] == found[:-1])
    return [sizes[:n], sizes[n:], np.bincount(at[1:][same], minlength=n)]


def _may_link(percent: int):
    """Whether sizes and bitmaps of a pair leave the needed similarity possible."""
    apart = sum((F.bit_count(F.col(f"mark{i}").bitwiseXOR(F.col(f"mark{i}_v"))) for i in range(MARKS)), F.lit(0))
    return _close("n", "n_v", percent) & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n_v")))


def _open_pairs(nodes: DataFrame, percent: int, m: int) -> DataFrame:
    """Pairs of nodes of different roots that share a table and can be links, each pair once.

    Nodes meet in each tuple of the first collection that they share; the pair comes from the first
    such tuple, and shares a table if it shares a tuple of the second collection too.
    """
    flat = nodes.select(
        "node", "root", "n", F.slice("bands", 1, m).alias("first"), F.slice("bands", m + 1, m).alias("second"),
        *[F.col("marks")[i].alias(f"mark{i}") for i in range(MARKS)],
    )
    rows = flat.select("*", F.posexplode("first").alias("i", "band"))
    # Of a bucket with many members each block meets each block, in tasks of its own; node < node_v leaves each pair once.
    sizes = rows.groupBy("band").agg(F.count("*").alias("c")).where(F.col("c") > MEET).select("band", F.ceil(F.col("c") / MEET).cast("int").alias("blocks"))
    rows = rows.join(sizes, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = rows.select("band", F.col("block").alias("later"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}_v") for c in flat.columns])
    rows = rows.withColumn("later", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    # Tuples hold their number, so equal ones stand at equal places.
    before = F.arrays_overlap(F.slice("first", 1, F.col("i")), F.slice("first_v", 1, F.col("i")))
    keep = (F.col("node") < F.col("node_v")) & (F.col("root") != F.col("root_v")) & _may_link(percent) & ~before & F.arrays_overlap("second", "second_v")
    return rows.join(other, ["band", "block", "later"]).where(keep).select(F.col("node").alias("u"), F.col("node_v").alias("v"), F.col("root").alias("root_u"), F.col("root_v"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, many: bool = False) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough; ``many`` of them may share one ``u``."""

    def check(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            step = max(1, int(len(a) * STEP_BYTES / max(1, a.nbytes + b.nbytes)))
            for low in range(0, len(a), step):
                part = batch.slice(low, step)
                one, two, both = _shared_counts(part.column(2), part.column(3))
                keep = pa.array(100 * both >= percent * (one + two - both))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["u", "v"])

    left = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    both = met_by_many(pairs.join(right, "v"), left, "u", "v", MEET, pairs) if many else pairs.join(left, "u").join(right, "v")
    both = both.select("u", "v", "text_u", "text_v")
    return both.mapInArrow(check, "u long, v long")


def _table_keys(classes: DataFrame) -> DataFrame:
    """(node, n, held, table): pairs of one tuple of each collection that other classes have as well; held counts a node's."""
    single = classes.where("n > 0").select("node", "n", F.explode("bands").alias("band"))
    shared = single.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    held = single.join(shared, "band", "left_semi").groupBy("node", "n").agg(F.collect_list("band").alias("bands"))
    first = F.filter("bands", lambda x: x.bitwiseAND(F.lit(1)) == 0)
    second = F.filter("bands", lambda x: x.bitwiseAND(F.lit(1)) == 1)
    tables = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x, y))))
    return held.select("node", "n", tables.alias("tables")).select("node", "n", F.size("tables").alias("held"), F.explode("tables").alias("table"))


def _close(n: str, m: str, percent: int):
    """Sizes that leave the needed similarity possible."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def grouped(docs: DataFrame, percent: int = PERCENT, m: int = TUPLES, k: int = WIDTH) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every document."""
    signed = written(signatures(docs, m, k))
    classes = written(
        signed.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("low_id"), F.min(F.struct("doc_id", "text_key", "bands", "marks")).alias("r"))
        .select("d1", "d2", "n", "low_id", "r.*").withColumn("node", F.monotonically_increasing_id())
    )
    tables = _table_keys(classes)
    buckets = tables.groupBy("table").agg(F.count("*").alias("c"), F.min(F.struct((-F.col("held")).alias("held"), "node", "n")).alias("p")).where("c > 1").select("table", "p")
    members = written(tables.join(buckets, "table").select("table", "node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")))
    # A pivot has more tables than the node, or as many and a smaller id, so these pairs make a forest.
    meets = members.where((F.col("node") != F.col("pivot")) & _close("n", "pivot_n", percent)).groupBy("node", "pivot").agg(F.count("*").alias("c"))
    first = written(meets.groupBy("node").agg(F.max(F.struct("c", "pivot")).alias("best")).select(F.col("best.pivot").alias("u"), F.col("node").alias("v")))
    texts = written(_texts(docs, classes.join(members.select("node").distinct(), "node", "left_semi")))
    links = written(confirmed(first, texts, percent, many=True))
    roots = tops(links.select(F.col("v").alias("node"), F.col("u").alias("parent")))
    placed = members.join(roots, "node", "left").select("table", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("table").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("table")
    open_nodes = placed.join(mixed, "table", "left_semi").select("node", "root").distinct().join(classes.select("node", "n", "bands", "marks"), "node")
    rest = written(_open_pairs(written(open_nodes), percent, m))
    more = confirmed(rest.select("u", "v"), texts, percent).join(rest, ["u", "v"]).select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    merged = components(more)
    placed = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # A root stands in no link as the lower end, so only the merged table can have it.
    named = placed.union(merged.join(roots, "node", "left_anti"))
    whole = classes.join(named, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = whole.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = whole.join(smallest, "root").select("d1", "d2", "n", "node", "component_id")
    return signed.select("doc_id", "text_key", "n", "d1", "d2").join(named, ["d1", "d2", "n"]).select(
        "doc_id", "text_key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One text of each of the classes."""
    wanted = classes.select("node", F.xxhash64("doc_id", "text_key").alias("key"), F.col("doc_id").alias("wanted_id"), F.col("text_key").alias("wanted_key"))
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).withColumn("key", F.xxhash64("doc_id", "text_key"))
    found = held.join(wanted, "key").where(F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_key") == F.col("wanted_key")))
    return found.select("key", "node", "text").dropDuplicates(["key", "node"]).select("node", "text")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return grouped(docs.select("doc_id", "text"), percent).drop("text_key")


def one_of_each_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents kept by `near_duplicates`, with their own columns, a repeated row once.

    Rows with a null id cannot be told apart and all stay.
    """
    kept = grouped(docs.select("doc_id", "text"), percent).where("kept").select("doc_id", "text_key").distinct()
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), F.struct("*").alias("row"))
    single = rows.join(kept, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("row.*")
    return single.unionByName(docs.where(F.col("doc_id").isNull()))
