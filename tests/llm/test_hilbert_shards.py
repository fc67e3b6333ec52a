"""The curve, the cut into shards, and pruning by manifest."""

import zlib
from itertools import product

from corpora import SCHEMA, corpus
from pyspark.sql import functions as F

from tidegauge.llm import hilbert_shards as op


def test_curve_visits_each_cell_once_by_steps_of_one(spark):
    for n, bits in ((2, 4), (3, 2), (4, 2)):
        cells = list(product(range(1 << bits), repeat=n))
        frame = spark.createDataFrame(cells, ", ".join(f"x{i} int" for i in range(n)))
        placed = frame.withColumn("h", op.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).collect()
        order = [tuple(r)[:n] for r in sorted(placed, key=lambda r: r.h)]
        assert sorted(r.h for r in placed) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(order, order[1:]))


def check(rows, got):
    n = len(rows)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, *_ in rows)
    sizes = [sum(r.shard == s for r in got) for s in range(8)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)


def test_shards_obey_the_law_and_follow_the_curve(spark):
    rows = corpus(9) + corpus(9)[:11] + [(None, "no id", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "shard")
    plan = op.shard_plan(docs)
    check(rows, op.shard_documents(docs).collect())
    walked = sorted(plan.collect(), key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in walked] == sorted(r.curve for r in walked)


def test_few_rows_and_empty_table(spark):
    rows = [(5, "a", "en", "s", 1), (5, "a", "en", "s", 1), (6, "b", "de", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check(rows, op.shard_documents(docs).collect())
    assert op.shard_documents(docs.limit(0)).count() == 0


def test_written_shards_hold_all_rows_and_pruning_keeps_matches(spark, tmp_path):
    rows = corpus(10) + corpus(10)[:3]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = op.shard_plan(docs)
    op.write_shards(docs, plan, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(str(tuple(r)[:-1]) for r in back.collect()) == sorted(str(tuple(r)) for r in rows)
    shards = op.manifest(plan)
    big = {r.shard for r in op.prune(shards, c_size=(op.size_cell(F.lit(400)), F.lit(255))).collect()}
    assert {r.shard for r in plan.where("size >= 400").collect()} <= big
    early = {r.shard for r in op.prune(shards, c_id=(F.lit(0), F.lit(40))).collect()}
    assert {r.shard for r in plan.where("c_id <= 40").collect()} <= early and len(early) < 8


def test_text_ids_and_ids_over_the_whole_range(spark):
    texts = [(t, "x" * k, "en", "s", k) for k, t in enumerate(["", "a", "ab", "é", "zz", None, "~" * 50_000, "0"])]
    docs = spark.createDataFrame(texts, "doc_id string, text string, lang string, source string, n_chars long")
    plan = op.shard_plan(docs).collect()
    assert sorted((r.shard for r in plan)) == list(range(8)) and all(0 <= r.c_id < 256 for r in plan)
    cells = {r.doc_id: r.c_id for r in plan}
    assert cells["a"] == cells["ab"] < cells["zz"] < cells["é"] and cells[None] == cells[""] == 0
    wide = [(i, "t", "en", "s", 1) for i in (-(1 << 63), -1, 0, (1 << 63) - 1, None)]
    cells = {r.doc_id: r.c_id for r in op.shard_plan(spark.createDataFrame(wide, SCHEMA)).collect()}
    assert cells == {-(1 << 63): 0, -1: 128, 0: 128, (1 << 63) - 1: 255, None: 0}


def test_very_long_texts_and_a_column_named_like_the_folders(spark, tmp_path):
    rows = [(i, "word " * 400_000 + str(i), "en", "s", i) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "shard_no")
    op.write_shards(docs, op.shard_plan(docs.withColumnRenamed("shard_no", "n_chars"), 2), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r.doc_id: r.shard_no for r in back.collect()} == {0: 0, 1: 1, 2: 2} and "shard_no_" in back.columns
