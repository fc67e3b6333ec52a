"""Held-out accuracy, folds and odd inputs of the quality model."""

import zlib

import pytest
from corpora import document

from tidegauge.llm import quality_model as op


def rows(n=600):
    import random

    rng, out = random.Random(2), []
    for i in range(n):
        text = document(rng, 5)
        if i % 4 == 0:
            junk = (" | ".join(text.split(" ")), " ".join(f"{w}***" for w in text.split(" ")), "Same " * 60)[i % 3]
            text = junk + "\n" + document(rng, 1)
        out.append((i, text, int(i % 4 != 0)))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    data = rows()
    odd = [(None, "no id", None), (10_000, None, 1), (10_001, "", 0), (10_002, "word " * 200000, None), (3, data[3][1], 1)]
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in data + odd], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data + odd], "doc_id long, quality int, toxic int")
    return data, op.quality_scores(docs, labels).collect()


def test_held_out_rows_are_told_apart(scored):
    data, got = scored
    truth = {i: q for i, _, q in data}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_folds_scores_and_odd_rows(scored):
    data, got = scored
    assert len(got) == len(data) + 5
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    by = {r.doc_id: r.score for r in got}
    assert by[10_000] == by[10_001] and by[10_002] < 0.3
    assert len([r for r in got if r.doc_id == 3]) == 2


def test_labels_of_the_held_out_fold_do_not_matter(spark, scored):
    data, got = scored
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in data]
    again = op.quality_scores(docs, spark.createDataFrame(flipped, "doc_id long, quality int")).collect()
    by = {r.doc_id: r.score for r in again}
    plain = {r.doc_id: r.score for r in op.quality_scores(docs, spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")).collect()}
    assert by == plain


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert op.quality_scores(docs, none).first().score == 0.5
    assert op.quality_scores(docs.limit(0), none).count() == 0


def test_sample_is_bounded_and_ordered(spark):
    data = rows(100)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    assert op.training_features(docs, labels, max_train=30).count() == 30


def test_a_repeated_id_gives_one_training_row(spark):
    data = rows(20)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(data[0][0], f"{t} again") for _, t, _ in data] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    once = docs.dropDuplicates(["doc_id"])
    assert op.training_features(docs, labels).count() == op.training_features(once, labels).count() <= 20
