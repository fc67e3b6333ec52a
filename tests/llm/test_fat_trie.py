"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tidegauge.llm import fat_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def expected(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append(((turn is not None, turn or 0, digest(role, text)), (role or "", text or "")))
    talks = {c: [x for _, x in sorted(found)] for c, found in talks.items()}
    made = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(talks.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, below, out = {}, {}, []
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves, saved = below.get(p[:d], (0, 0))
            below[p[:d]] = leaves + (p not in children), saved + (len(who) - 1) * words
    for p, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(made[c]) == len(p))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children.get(p, 0), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got(frame, **options):
    return sorted((tuple(r[c] for c in COLUMNS) for r in fat_trie.prefix_trie(frame, **options).collect()), key=str)


def test_forks_copies_and_a_hot_first_turn(spark):
    rng = random.Random(2)
    rows = []
    for c in range(160):
        shared = ["hello there"] * (c % 3 == 0) + [f"path {x}" for x in rng.choices("ab", k=rng.randint(0, 5))] * (c % 2)
        turns = shared + [f"own words {c} {i}" for i in range(rng.randint(0, 4))]
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)]
    rows += [(1000 + c, i, "user", f"the same {i}") for c in range(40) for i in range(6)]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_conversations_longer_than_a_segment(spark):
    """Chains across segments, forks inside and at their borders, and a prefix of another conversation."""
    base = [f"turn {i}" for i in range(23)]
    rows = [(c, i, "u", t) for c, length in ((0, 23), (1, 23), (2, 8), (3, 9), (4, 17)) for i, t in enumerate(base[:length])]
    rows += [(c, i, "u", t if i < fork else f"{t} {c}") for c, fork in ((21, 4), (22, 8), (23, 15), (45, 16), (61, 22)) for i, t in enumerate(base)]
    assert got(spark.createDataFrame(rows, SCHEMA), segment=4) == expected(rows)


def test_nulls_ties_repeated_rows_and_missing_families(spark):
    rows = [(None, 0, "u", "x"), (20, None, "u", None), (20, 0, None, "a b"), (20, 0, "u", "a b"), (21, 5, None, None), (22, 1, "u", "")]
    rows += [(7, 0, "u", "alone")] * 2 + [(45, 0, "u", "one")] + [(-19, 0, "u", "below zero"), (-20, 3, "u", "so"), (-1, 2, "", "é" * 200_000 + " end")]
    frame = spark.createDataFrame(rows, SCHEMA)
    # A remainder keeps the sign of its number here, so the plain version is told the same.
    plain = [r for r in rows if r[0] is None or r[0] >= 0]
    assert got(frame.where("conv_id >= 0 OR conv_id IS NULL")) == expected(plain)
    assert sum(r[1] == 0 for r in got(frame)) == 1
    assert got(frame.limit(0)) == [] and got(frame.where("conv_id IS NULL")) == []


def test_clashing_columns(spark):
    rows = [(c, i, "u", f"t {c % 3} {i}") for c in range(6) for i in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("c", "idx", "n", "tree", "keys", "digest", "words", "end"):
        frame = frame.withColumn(name, F.lit("x"))
    assert got(frame) == expected(rows)


def test_handles(spark):
    """The number of an interval that is divisible by the largest power of two."""
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 70)] + [(1 << 40, (1 << 40) + 7)]
    frame = spark.createDataFrame(pairs, "a long, b long").select("a", "b", fat_trie.fattest(F.col("a"), F.col("b")).alias("f"))
    for a, b, f in frame.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_ids_of_many_equal_conversations_are_hashed_in_order(spark):
    ends = spark.range(30_000).selectExpr("cast('k' AS binary) AS key", "id AS c").unionByName(spark.range(3).selectExpr("cast(id AS string) AS key", "id AS c").selectExpr("cast(key AS binary) AS key", "c"))
    found = {bytes(r.key): r.ends_sha256 for r in fat_trie.id_digests(ends).collect()}
    assert found[b"k"] == hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest()
    assert found[b"2"] == hashlib.sha256(b"2").hexdigest() and len(found) == 4
