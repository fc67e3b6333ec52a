"""Merkle manifests against a plain tree, node by node."""

import hashlib
import random
import zlib

from corpora import SCHEMA, corpus
from pyspark.sql import functions as F

from tidegauge.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n_chars = row
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)])


def built(nodes):
    """Root of some nodes, and the (left, right) siblings of each on its way."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [(nodes[k : k + 3], owners[k : k + 3]) for k in range(0, len(nodes), 3)]
        for run, who in runs:
            for j, below in enumerate(who):
                for i in below:
                    proofs[i].append((run[:j], run[j + 1 :]))
        nodes, owners = [digest(*run) for run, _ in runs], [sum(who, []) for _, who in runs]
    return nodes[0], proofs


def expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[3], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    whole = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        whole[name] = built([leaf(r, r[1]) for r in trees[name]])
    root, above = built([whole[name][0] for name in names])
    out = []
    for name, top in zip(names, above):
        for row, proof in zip(trees[name], whole[name][1]):
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            at = leaf(row, text)
            for left, right in proof + top:
                at = digest(*left, at, *right)
            siblings = digest(*[x for left, right in proof + top for x in left + right])
            out.append((row[0], leaf(row, row[1]), whole[name][0], root, siblings, at, at == root))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in merkle.tampering_report(frame).collect()), key=str)


def test_proofs_equal_a_plain_tree(spark):
    rng = random.Random(4)
    rows = corpus(4)
    # One source far larger than the others, of every remainder of a run, and some of one row.
    rows += [(1000 + i, f"line {i}\nmore", "en", "hot", 1) for i in range(800)]
    rows += [(5000 + i, "x\ny", None, f"one{i}é", None) for i in range(11)] + [(6000 + i, "two", "en", "two", 3) for i in range(2)]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_null_fields_repeated_rows_long_texts_and_empty_tables(spark):
    rows = [(None, None, None, None, None)] * 2 + [(7, "a\nb", "en", "s", 3)] * 4 + [(7, "other", "en", "s", 5), (8, "", "", "", 0), (9, "é\n" * 500_000, "en", "s", 9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(frame) == expected(rows)
    assert merkle.tampering_report(frame.limit(0)).count() == 0
    single = [(3, "only\none", "en", "s", 8)]
    assert got(spark.createDataFrame(single, SCHEMA)) == expected(single)


def test_columns_with_internal_names_change_nothing(spark):
    rows = corpus(6)[:30]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "idx", "n", "id", "digest", "steps", "at", "part"):
        docs = docs.withColumn(name, F.lit("x"))
    assert got(docs) == expected(rows)


def test_jumps_copy_ancestors_that_many_ask_for(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPREAD", 1)
    monkeypatch.setattr(merkle, "_BLOCK", 3)
    rows = [(i, f"t\n{i}", "en", "s" if i % 3 else f"o{i % 7}", 1) for i in range(400)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_stored_proofs_find_changed_missing_and_new_rows(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 4}", 6) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    proofs = merkle.manifest(merkle.document_leaves(docs))
    later = [r for r in rows if r[0] != 9]
    later[3] = (3, "changed", "en", "s3", 6)
    later.append((99, "new", "en", "s0", 3))
    bad = {r.id for r in merkle.verify(spark.createDataFrame(later, SCHEMA), proofs).collect() if not r.verified}
    assert bad == {3, 9, 99}
