"""Merkle manifest of a table: leaf digests, a tree for each source, a tree over their roots, and proofs.

A leaf is the SHA-256 of a row's fields. Leaves of a source are numbered in order; every ``FAN``
consecutive nodes of a level become one digest, until one node remains. The sources' roots make a
tree of their own. Digests are kept as 32 bytes and hashed as lower-case hex.

Proofs come by pointer jumping. At first each node holds the one step to its parent, its siblings to
the left and to the right. A self-join then appends the steps of the node's ancestor, so the way to the
ancestor doubles; only levels that are still somebody's ancestor stay, so the table is soon as short as
the leaves. After log2(height) joins every leaf reaches its root.

Scale: texts are hashed where they are read and never shuffled. Leaves are dealt by range of (source,
order, digest), so a source with a third of all rows lies in many tasks; places come from counts of
(partition, source). ``CLIMB`` levels are built from one grouping of at most ``FAN ** CLIMB`` nodes. An ancestor
that more than ``FAN ** SPREAD`` nodes ask for is copied once for each block of as many. Every round is
written to the shared folder.

Defined results: a null field is ``-``; rows without a source are one source, the first; rows without an
id come first in their source; rows that share an id are ordered by their digest, and repeated rows
stand next to each other, each with its own proof; an empty table has no rows. Columns other than those
asked for are not read, and internal names cannot clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.shared import written

FAN = 3
CLIMB = 6
SPREAD = 8
_BLOCK = FAN**SPREAD
_STEP = "struct<left: binary, right: binary>"
_STEPS = f"array<{_STEP}>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and its value, or ``-`` for null."""
    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return _digest(F.concat(*[one(f) for f in fields]))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``idx``, their place in their ``tree`` from 0, and ``n``, the rows of that tree."""
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))
    counts = placed.groupBy("tree", "part").agg(F.min("pos").alias("first"), F.count("*").alias("c"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each (partition, tree), at most partitions plus trees.
    offsets = counts.select("tree", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    return placed.join(offsets, ["tree", "part"]).withColumn("idx", F.col("pos") + F.col("shift")).drop("at", "part", "pos", "first", "shift")


def _climbed(nodes: DataFrame, base: int) -> DataFrame:
    """From all nodes of level ``base``: one row for each block, with the steps of its nodes and its top digests.

    ``steps`` are (level, idx, step) of up to ``CLIMB`` levels; ``tops`` are (idx, digest) of the level reached.
    """
    width = FAN**CLIMB
    block = F.expr(f"idx div {width}")
    blocks = nodes.groupBy("tree", "n", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("held"))

    def run_of(a: Column, i: Column) -> Column:
        return F.slice(a, i - i % FAN + 1, F.lit(FAN))

    def joined(a: Column) -> Column:
        return F.aggregate(a, F.lit(b""), lambda text, d: F.concat(text, d))

    def parents(a: Column) -> Column:
        heads = F.filter(F.transform(a, lambda d, i: i), lambda i: i % FAN == 0)
        return F.transform(heads, lambda i: _digest(hexed(joined(run_of(a, i)))))

    def steps(a: Column, level: Column, first: Column) -> Column:
        def one(d: Column, i: Column) -> Column:
            left = F.slice(a, i - i % FAN + 1, i % FAN)
            right = F.slice(a, i + 2, F.lit(FAN - 1) - i % FAN)
            return F.struct(level.alias("level"), (first + i).alias("idx"), F.struct(joined(left).alias("left"), joined(right).alias("right")).alias("step"))

        return F.transform(a, one)

    def climb(state: Column, k: Column) -> Column:
        return F.when(state["n"] <= 1, state).otherwise(F.struct(
            F.floor((state["n"] + (FAN - 1)) / FAN).cast("long").alias("n"), (k + base).cast("int").alias("level"),
            F.floor(state["first"] / FAN).cast("long").alias("first"), parents(state["a"]).alias("a"),
            F.concat(state["steps"], steps(state["a"], (k + (base - 1)).cast("int"), state["first"])).alias("steps"),
        ))

    start = F.struct(
        F.col("left").alias("n"), F.lit(base).cast("int").alias("level"), (F.col("block") * width).cast("long").alias("first"),
        F.transform("held", lambda x: x["digest"]).alias("a"), F.array().cast(f"array<struct<level: int, idx: bigint, step: {_STEP}>>").alias("steps"),
    )
    left = F.ceil(F.col("n") / F.lit(FAN**base)).cast("long")
    state = blocks.withColumn("left", left).select("tree", "n", F.aggregate(F.sequence(F.lit(1), F.lit(CLIMB)), start, climb).alias("s"))
    return state.select(
        "tree", "n", F.col("s.n").alias("left"), "s.level", "s.steps", F.transform("s.a", lambda d, i: F.struct((F.col("s.first") + i).alias("idx"), d.alias("digest"))).alias("tops")
    )


def _jumped(steps: DataFrame, tall: int) -> DataFrame:
    """(tree, idx, steps) of the leaves, from (tree, level, idx, steps) of single steps of all nodes."""
    d = 1
    while d < tall:
        asking = steps.where(F.col("level") % (2 * d) == 0).withColumn("block", F.expr(f"idx div {FAN ** min(d, SPREAD)}"))
        there = steps.where(F.col("level") % (2 * d) == d).select("tree", (F.col("level") - d).alias("level"), F.col("idx").alias("block"), F.col("steps").alias("more"))
        if d > SPREAD:
            copies = FAN ** (d - SPREAD)
            there = there.withColumn("block", F.explode(F.sequence(F.col("block") * copies, F.col("block") * copies + (copies - 1))))
        joined = asking.join(there, ["tree", "level", "block"], "left")
        steps = written(joined.select("tree", "level", "idx", F.concat("steps", F.coalesce("more", F.array().cast(_STEPS))).alias("steps")))
        d *= 2
    return steps.where("level = 0").select("tree", "idx", "steps")


def forest(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proof steps (tree, idx, steps) of all nodes (tree, idx, n, digest), and the roots (tree, n, digest).

    The node of a tree that has no other is its root and has no steps.
    """
    roots, steps, base = [], [], 0
    while True:
        climbed = written(_climbed(nodes, base))
        roots.append(climbed.where("left = 1").select("tree", "n", F.col("tops")[0]["digest"].alias("digest")))
        steps.append(climbed.select("tree", F.explode("steps").alias("s")).select("tree", "s.level", "s.idx", F.array("s.step").alias("steps")))
        nodes = climbed.where("left > 1").select("tree", "n", F.explode("tops").alias("t")).select("tree", "n", "t.*")
        tall = climbed.agg(F.max("level"), F.max("left")).first()
        base += CLIMB
        if (tall[1] or 0) <= 1:
            break
    union = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(union(tables[1:]))
    return _jumped(union(steps), tall[0] or 0), union(roots)


def manifest(rows: DataFrame) -> DataFrame:
    """Rows (tree, id, digest and others) with their proof ``steps`` to the root, ``subroot`` and ``root``.

    Trees are ordered by the bytes of their name, leaves by id and digest.
    """
    leaves = ranked(written(rows), ["id", "digest"])
    steps, subroots = forest(leaves.select("tree", "idx", "n", "digest"))
    subroots = written(subroots)
    tops = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    above, roots = forest(tops.select("tree", "idx", "n", "digest"))
    found = roots.first()
    if found is None:
        return leaves.select(*rows.columns, F.array().cast(_STEPS).alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = tops.drop("n").join(above, ["tree", "idx"], "left").select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.coalesce("steps", F.array().cast(_STEPS)).alias("above"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_BLOCK}"))).alias("block")
    tops = tops.join(subroots.select("tree", "n"), "tree").select("tree", "subroot", "above", blocks)
    placed = leaves.join(steps, ["tree", "idx"], "left").withColumn("block", F.expr(f"idx div {_BLOCK}")).join(tops, ["tree", "block"])
    return placed.select(*rows.columns, F.concat(F.coalesce("steps", F.array().cast(_STEPS)), "above").alias("steps"), "subroot", F.lit(bytes(found.digest)).alias("root"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, leaf, lambda d, s: _digest(F.concat(hexed(s["left"]), hexed(d), hexed(s["right"]))))


def siblings_digest(steps: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf up and from left to right."""
    return _digest(F.array_join(F.transform(steps, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), ""))


def document_leaves(docs: DataFrame, *more: Column) -> DataFrame:
    """tree, id and digest of every document, and further columns."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").alias("id"), leaf_digest([F.col(c) for c in FIELDS]).alias("digest"), *more)


def tampering_report(docs: DataFrame) -> DataFrame:
    """Proof of every document, and what it gives after line ends were deleted from half of the texts.

    Rows with a null id are not tampered with.
    """
    bare = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = leaf_digest([bare if c == "text" else F.col(c) for c in FIELDS])
    proved = manifest(document_leaves(docs, changed.alias("changed")))
    seen = proved.select("*", folded(F.col("changed"), F.col("steps")).alias("folded"))
    return seen.select(
        F.col("id").alias("doc_id"), hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        hexed(siblings_digest(F.col("steps"))).alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def verify(docs: DataFrame, proofs: DataFrame) -> DataFrame:
    """Documents of today against stored proofs (id, steps, root): id and whether their row still leads to the root.

    A document without a proof, and a proof without its document, is not verified. Ids must be unique and not null.
    """
    now = document_leaves(docs).select("id", F.col("digest").alias("now"))
    both = proofs.select("id", "steps", "root").join(now, "id", "full")
    return both.select("id", F.coalesce(folded(F.col("now"), F.col("steps")) == F.col("root"), F.lit(False)).alias("verified"))
