"""Prefix trie of conversations: a z-fast trie, held as tables and filled in batches.

A conversation is a sequence of turns. Every prefix has a key, 128 bits of a SHA-256 chain over its turns.
The compacted trie keeps one row for each node that branches or ends a conversation: its depth, the depth of its
parent, and the keys along the edge between them. The row is found by the key at its handle, the depth in that
interval that is divisible by the largest power of two.

Insertion. A batch of sequences is located by fat binary search: one join on handles halves the
depths that are left. What is found either lies on the path, so the search goes on below it, or is the exit node,
whose edge tells by its keys where the sequence leaves it. Edges are cut there, and one sequence for each new branch is
hung on; the others of that branch wait for the next batch. The one inserted is arbitrary (the least key), so the
number of batches grows as the logarithm of the sequences. Equal sequences are one, with a count.

Subtree sums (members, leaves, words) double their reach over the compacted trie in each round; then edges expand to one
row for each prefix.

Scale: texts are hashed where they are read and never shuffled. A conversation of any number of turns is placed by range,
and cut into segments of ``SEGMENT`` turns, so no array grows with it; each segment's start is a node, the root of what
follows, and the chain is carried over one short row for each segment. Handles and edges meet sequences in joins that adaptive
execution splits where one prefix is shared by very many sequences; sums are aggregated before they are shuffled. Ids of equal
conversations are joined to texts where they lie, then hashed as a stream in order, never collected.

Defined results: null role and text count as empty; turns come by number, null first, turns of one number by a digest of role
and text; repeated rows are turns of their own; rows without a conv_id are no conversation; a conversation left without
turns ends at the root; an empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.merkle import ranked
from tidegauge.llm.shared import written

SEGMENT = 1024
FAMILY, HEADS = 20, 4
_ROWS = 1 << 16
_ROOT = bytearray(b"")


def turn_table(talks: DataFrame) -> DataFrame:
    """c, idx (place from 0), n (turns), digest and words of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = talks.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("tree"), "turn", F.unhex(named).alias("digest"), words.alias("words"))
    return ranked(written(rows), ["turn", "digest"]).select(F.col("tree").alias("c"), "idx", "n", "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, d, digest, words) with the first h of their family's first conversation in front, d from 1, and (c, m) of all conversations."""
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).cast("long")
    talks = written(turns.where("idx = 0").select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("first")))
    bases = turns.where((F.col("c") % FAMILY == 0) & (F.col("idx") < HEADS - 1)).select(F.col("c").alias("first"), "idx", "n", "digest", "words")
    counts = bases.where("idx = 0").select("first", F.col("n").alias("held"))
    taken = F.least(F.col("h"), F.coalesce("held", F.lit(0)))
    talks = talks.join(counts, "first", "left").select("c", "n", "h", "first", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m"))
    front = talks.join(bases.select("first", "idx", "digest", "words"), "first").where("idx < h").select("c", (F.col("idx") + 1).alias("d"), "m", "digest", "words")
    places = talks.select("c", "h", "k", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_ROWS}"))).alias("block"))
    own = turns.withColumn("block", F.expr(f"idx div {_ROWS}")).join(places, ["c", "block"]).where("idx >= h")
    own = own.select("c", (F.col("idx") - F.col("h") + F.col("k") + 1).alias("d"), "m", "digest", "words")
    return own.unionByName(front), talks.select("c", "m")


def _short(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()[:16]


def _chain(items) -> list[bytes]:
    return list(accumulate(items, _short, initial=b""))[1:]


def segments(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """c, low (turns before), start (key before), before (words before), keys and cum (words up to each), last, of every ``size`` turns."""
    grouped = turns.groupBy("c", "m", F.expr(f"(d - 1) div {size}").alias("seg")).agg(F.sort_array(F.collect_list(F.struct("d", "digest", "words"))).alias("held"))
    grouped = grouped.select("c", "m", "seg", F.transform("held", lambda x: x["digest"]).alias("digests"), F.transform("held", lambda x: x["words"]).alias("words"))

    def chained(batches):
        for batch in batches:
            chains = [_chain(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(chains, pa.list_(pa.binary())), batch.column(4)], ["c", "m", "seg", "chain", "words"])

    own = written(grouped.mapInArrow(chained, "c long, m long, seg long, chain array<binary>, words array<long>"))

    def carried(batches):
        """Key and words before each segment but the first of its conversation."""
        talk, key, words = None, b"", 0
        for batch in batches:
            out = []
            for c, seg, chain, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != talk:
                    talk, key, words = c, b"", 0
                key, words = _short(key, chain), words + n
                out.append((c, seg + 1, key, words))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["c", "seg", "start", "before"])

    # Only conversations longer than a segment, with one short row for each.
    long = own.where(F.col("m") > size).select("c", "seg", F.element_at("chain", -1).alias("chain"), F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    starts = long.repartition("c").sortWithinPartitions("c", "seg").mapInArrow(carried, "c long, seg long, start binary, before long")
    placed = own.join(starts, ["c", "seg"], "left")

    def keyed(batches):
        for batch in batches:
            starts = [x or b"" for x in batch.column(3).to_pylist()]
            before = [x or 0 for x in batch.column(4).to_pylist()]
            keys = [[_short(start, x) for x in chain] for start, chain in zip(starts, batch.column(5).to_pylist(), strict=True)]
            cum = [list(accumulate(words, initial=n))[1:] for n, words in zip(before, batch.column(6).to_pylist(), strict=True)]
            arrays = [*batch.columns[:3], pa.array(starts, pa.binary()), pa.array(before, pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(cum, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["c", "low", "last", "start", "before", "keys", "cum"])

    ordered = placed.select("c", (F.col("seg") * size).alias("low"), ((F.col("seg") + 1) * size >= F.col("m")).alias("last"), "start", "before", "chain", "words")
    return ordered.mapInArrow(keyed, "c long, low long, last boolean, start binary, before long, keys array<binary>, cum array<long>")


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the largest power of two."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return high - high % F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def _node(low: Column, keys: Column, cum: Column, up: Column, up_key: Column, up_words: Column) -> list[Column]:
    """Columns of a node whose edge ends with the last of ``keys``; ``keys`` and ``cum`` hold the edge, from depth ``up`` + 1."""
    depth = up + F.size(keys)
    return [
        F.element_at(keys, -1).alias("key"), depth.alias("depth"), up.alias("up"), up_key.alias("up_key"), up_words.alias("up_words"), low.alias("low"),
        F.element_at(keys, (fattest(up, depth) - up).cast("int")).alias("handle"), keys[0].alias("first"), keys.alias("keys"), cum.alias("cum"),
    ]


def _at(values: Column, low: Column, depth: Column, start: Column) -> Column:
    """Value of a segment at a depth; ``start`` at its own low."""
    return F.when(depth == low, start).otherwise(F.get(values, (depth - low - 1).cast("int")))


def _located(waiting: DataFrame, trie: DataFrame, rounds: int) -> DataFrame:
    """``waiting`` with the exit node's key and depths, and the depth at which the sequence leaves the trie."""
    end = F.col("low") + F.size("keys")
    state = waiting.withColumns({"lo": F.col("low"), "hi": end, "exit": F.lit(None).cast("binary")})
    handles = trie.select(F.col("handle").alias("probe"), F.col("key").alias("node_key"), F.col("depth").alias("node_depth"))
    for _ in range(rounds):
        open_ = (F.col("lo") < F.col("hi")) & F.col("exit").isNull()
        probe = F.when(open_, F.get("keys", (fattest(F.col("lo"), F.col("hi")) - F.col("low") - 1).cast("int")))
        # Closed ones ask for what is nowhere, each for its own.
        state = state.withColumn("probe", F.coalesce(probe, F.concat(F.lit(bytearray(b"-")), "end"))).join(handles, "probe", "left")
        hit, open_ = F.col("node_key").isNotNull(), F.length("probe") == 16
        on_path = hit & (F.col("node_depth") <= end) & (F.get("keys", (F.col("node_depth") - F.col("low") - 1).cast("int")) == F.col("node_key"))
        lower = F.when(open_ & ~hit, fattest(F.col("lo"), F.col("hi")) - 1).otherwise(F.col("hi"))
        state = state.select(
            *waiting.columns, F.when(F.coalesce(on_path, F.lit(False)), F.col("node_depth")).otherwise(F.col("lo")).alias("lo"), lower.alias("hi"),
            F.when(hit & ~on_path, F.col("node_key")).otherwise(F.col("exit")).alias("exit"),
        )
    # No handle on the way: the exit may still be the child that begins with the next turn.
    ask = F.when(F.col("exit").isNull() & (F.col("lo") < end), F.get("keys", (F.col("lo") - F.col("low")).cast("int")))
    state = state.withColumn("ask", F.coalesce(ask, F.concat(F.lit(bytearray(b"-")), "end")))
    state = state.join(trie.select(F.col("first").alias("ask"), F.col("key").alias("child")), "ask", "left").withColumn("exit", F.coalesce("exit", "child"))
    edges = trie.select(F.col("key").alias("exit"), F.col("up").alias("exit_up"), F.col("depth").alias("exit_depth"), F.col("keys").alias("edge"))
    state = state.withColumn("exit", F.coalesce("exit", F.concat(F.lit(bytearray(b"-")), "end"))).join(edges, "exit", "left")
    same = F.size(F.filter("edge", lambda k, j: k.eqNullSafe(F.get("keys", (F.col("exit_up") - F.col("low") + j).cast("int")))))
    leaves = F.when(F.col("exit_up").isNotNull(), F.col("exit_up") + same).otherwise(F.col("lo"))
    return state.select(*waiting.columns, F.when(F.col("exit_up").isNotNull(), F.col("exit")).alias("exit"), "exit_up", "exit_depth", leaves.cast("long").alias("leaves"))


def _cut(trie: DataFrame, found: DataFrame) -> DataFrame:
    """The trie with edges cut at the depths where located sequences leave them."""
    inside = (F.col("leaves") > F.col("exit_up")) & (F.col("leaves") < F.col("exit_depth"))
    cuts = found.where(inside).groupBy(F.col("exit").alias("key")).agg(F.sort_array(F.collect_set("leaves")).alias("cuts"))
    joined = trie.join(cuts, "key", "left")
    whole = joined.where("cuts IS NULL").drop("cuts")
    pieces = joined.where("cuts IS NOT NULL").withColumn("ends", F.concat("cuts", F.array("depth"))).select("*", F.posexplode("ends").alias("i", "stop"))
    begin = F.when(F.col("i") == 0, F.col("up")).otherwise(F.get("ends", F.col("i") - 1))
    pieces = pieces.withColumn("begin", begin)
    place, length = (F.col("begin") - F.col("up")).cast("int"), (F.col("stop") - F.col("begin")).cast("int")
    above = lambda values, at_top: F.when(place == 0, at_top).otherwise(F.get(values, place - 1))
    pieces = pieces.select(
        "low", F.slice("keys", place + 1, length).alias("keys"), F.slice("cum", place + 1, length).alias("cum"),
        F.col("begin").alias("up"), above("keys", F.col("up_key")).alias("up_key"), above("cum", F.col("up_words")).alias("up_words"),
    )
    return whole.unionByName(pieces.select(*_node(*[F.col(c) for c in ("low", "keys", "cum", "up", "up_key", "up_words")])))


def insert(trie: DataFrame | None, sequences: DataFrame) -> DataFrame:
    """The trie with all sequences (end, low, start, before, keys, cum) in it, batch by batch."""
    waiting = written(sequences.select("end", "low", "start", "before", "keys", "cum"))
    longest = waiting.agg(F.max(F.size("keys"))).first()[0]
    rounds = int(longest).bit_length() + 1 if longest else 0
    while True:
        if trie is None:
            found = waiting.select("*", F.lit(None).cast("binary").alias("exit"), F.lit(None).cast("long").alias("exit_up"), F.lit(None).cast("long").alias("exit_depth"), F.col("low").alias("leaves"))
        else:
            found = written(_located(waiting, trie, rounds))
            trie = _cut(trie, found)
        branch = F.get("keys", (F.col("leaves") - F.col("low")).cast("int"))
        new = found.where(F.col("leaves") < F.col("low") + F.size("keys")).withColumn("branch", branch)
        chosen = written(new.groupBy("branch").agg(F.min("end").alias("end")).select("end"))
        place = (F.col("leaves") - F.col("low")).cast("int")
        tails = new.join(chosen, "end", "left_semi").select(
            "low", F.slice("keys", place + 1, F.size("keys") - place).alias("keys"), F.slice("cum", place + 1, F.size("keys") - place).alias("cum"), F.col("leaves").alias("up"),
            _at(F.col("keys"), F.col("low"), F.col("leaves"), F.col("start")).alias("up_key"), _at(F.col("cum"), F.col("low"), F.col("leaves"), F.col("before")).alias("up_words"),
        )
        tails = tails.select(*_node(*[F.col(c) for c in ("low", "keys", "cum", "up", "up_key", "up_words")]))
        trie = written(tails if trie is None else trie.unionByName(tails))
        waiting = written(new.join(chosen, "end", "left_anti").select(*waiting.columns))
        if waiting.isEmpty():
            return trie


def id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids ``c`` of each ``key``, ascending and joined by commas, as a stream over runs that are joined where they lie."""

    def joined(batches):
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            heads = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]] + [len(keys)]
            runs = [(keys[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(heads, heads[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in runs], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["key", "head", "ids"])

    def hashed(batches):
        key = state = None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is not None and k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    runs = ends.select("key", "c").repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(joined, "key binary, head long, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "head").mapInArrow(hashed, "key binary, ends_sha256 string")


_SUMS = ("n", "leaves", "weighted", "words")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """key, sums and the least id over all nodes below, for nodes (key, up_key, least and sums of their own); the root's up_key is null."""
    state = written(nodes.select("key", F.col("up_key").alias("ptr"), "least", *_SUMS))
    while not state.where("ptr IS NOT NULL").isEmpty():
        below = state.where("ptr IS NOT NULL").groupBy("ptr").agg(F.min("least").alias("b_least"), *[F.sum(c).alias(f"b_{c}") for c in _SUMS])
        # Pointers to the root end here, so the root is nobody's partner in the second join.
        moving = state.withColumn("ptr", F.when(F.length("ptr") > 0, F.col("ptr")))
        over = state.where(F.length("key") > 0).select(F.col("key").alias("ptr"), F.col("ptr").alias("next"))
        moved = moving.where("ptr IS NOT NULL").join(over, "ptr", "left").select("key", F.col("next").alias("ptr"), "least", *_SUMS)
        moved = moved.unionByName(moving.where("ptr IS NULL").select("key", "ptr", "least", *_SUMS))
        joined = moved.join(below.withColumnRenamed("ptr", "key"), "key", "left")
        state = written(joined.select("key", "ptr", F.least("least", "b_least").alias("least"), *[(F.col(c) + F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in _SUMS]))
    return state.drop("ptr")


def prefix_trie(talks: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each prefix of the rebuilt conversations."""
    turns, whole = rebuilt(turn_table(talks))
    parts = written(segments(turns, segment).withColumn("end", F.element_at("keys", -1)))
    bare = whole.where("m = 0").select(F.lit(_ROOT).alias("key"), "c")
    ends = written(parts.where("last").select(F.col("end").alias("key"), "c").unionByName(bare))
    # One of the equal segments carries the arrays.
    sequences = parts.groupBy("end").agg(F.first(F.struct("low", "start", "before", "keys", "cum")).alias("s")).select("end", "s.*")
    trie = insert(None, sequences)
    counts = ends.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("least"))
    children = trie.groupBy(F.col("up_key").alias("key")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    root = talks.sparkSession.range(1).select(F.lit(_ROOT).alias("key"), F.lit(None).cast("binary").alias("up_key"), zero.alias("total"), zero.alias("words"))
    nodes = trie.select("key", "up_key", F.element_at("cum", -1).alias("total"), (F.element_at("cum", -1) - F.col("up_words")).alias("words")).unionByName(root)
    nodes = nodes.join(counts, "key", "left").join(children, "key", "left").select(
        "key", "up_key", "total", "words", "least", F.coalesce("n", zero).alias("n"), F.coalesce("n_children", zero).alias("n_children"),
    )
    nodes = written(nodes.withColumns({"leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "weighted": F.col("n") * F.col("total")}))
    sums = written(subtree_sums(nodes).where("n > 0"))
    top = sums.where(F.length("key") == 0).first()
    top_least = F.lit(top.least if top else None).cast("long")
    parents = sums.where(F.length("key") > 0).select(F.col("key").alias("up_key"), F.col("least").alias("above"))
    shas = id_digests(ends)
    facts = sums.join(nodes.select("key", "n_children"), "key").join(shas, "key", "left")
    under = trie.where(F.length("up_key") > 0).join(parents, "up_key").unionByName(trie.where(F.length("up_key") == 0).withColumn("above", top_least))
    rows = under.select("key", "up", "up_words", "above", "cum").join(facts, "key").select("*", F.posexplode("cum").alias("j", "reach"))
    at_end = F.col("j") == F.size("cum") - 1
    before = F.when(F.col("j") == 0, F.col("up_words")).otherwise(F.get("cum", F.col("j") - 1))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    inner = rows.select(
        F.col("least").alias("conv_id"), (F.col("up") + F.col("j") + 1).alias("depth"), F.when(F.col("j") == 0, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(at_end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("weighted") - before * F.col("n") - F.col("words") + (before - F.col("up_words"))).alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"),
    )
    outer = facts.where(F.length("key") == 0).select(
        F.col("least").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("weighted") - F.col("words")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    return inner.unionByName(outer)
