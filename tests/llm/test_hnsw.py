"""Graph search against brute force."""

import math

import numpy as np

from tidegauge.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label string"


def exact(rows, k=20):
    """query -> [(vec_id, score)], by all products."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in usable:
        if i % 20 == 0:
            out[i] = sorted(((-float(q @ v), j) for j, v in usable if j != i and len(v) == len(q)))[:k]
    return {i: [(j, -s) for s, j in found] for i, found in out.items() if found}


def got(frame, **options):
    out = {}
    for r in sorted(hnsw.nearest(frame, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, true):
    assert found.keys() == true.keys()
    return np.mean([len({j for j, _ in found[i]} & {j for j, _ in true[i]}) / len(true[i]) for i in true])


def frame_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], SCHEMA)


def test_recall_scores_and_order_over_several_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 32))
    # Lengths differ, so the largest product is not the smallest angle.
    vectors = ((centres[rng.integers(8, size=3000)] + rng.normal(size=(3000, 32))) * rng.uniform(0.2, 3, size=(3000, 1))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    true, found = exact(rows), got(frame_of(spark, rows), shard_rows=1100)
    assert recall(found, true) >= 0.95
    by_id = dict(rows)
    for i, best in found.items():
        assert len(best) == 20 and len({j for j, _ in best}) == 20 and all(j != i for j, _ in best)
        assert best == sorted(best, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float(np.dot(np.array(by_id[i]), np.array(by_id[j])))) < 1e-9 for j, s in best)


def test_equal_and_nearly_equal_vectors(spark):
    """A third of the rows are one vector, others differ from one by little: all stay reachable, ties go to the smaller id."""
    rng = np.random.default_rng(5)
    base, other = rng.normal(size=16), rng.normal(size=16)
    rows = [(i, base.astype(np.float32).tolist()) for i in range(0, 900, 2)]
    rows += [(i, (other + 1e-4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1, 900, 2)]
    rows += [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(900, 1400)]
    true, found = exact(rows), got(frame_of(spark, rows), shard_rows=700)
    assert recall(found, true) >= 0.95
    assert [j for j, _ in found[100]] == [j for j, _ in true[100]]


def test_few_rows_are_all_found(spark):
    rows = [(0, [1, 0]), (20, [0.5, 0.5]), (3, [1, 0]), (4, [-1, 0]), (5, [1, 0]), (6, [1e30, 1e30])]
    true, found = exact(rows), got(frame_of(spark, rows))
    assert {i: [j for j, _ in x] for i, x in found.items()} == {i: [j for j, _ in x] for i, x in true.items()}


def test_rows_that_take_no_part_and_other_lengths(spark):
    rows = [(0, None), (20, []), (40, [0, 0]), (60, [1, None]), (80, [float("nan"), 1]), (100, [float("inf"), 1]), (None, [1, 1])]
    rows += [(120, [1, 2]), (1, [3, 4]), (140, [1, 2, 3]), (2, [1, 1, 1]), (160, [7]), (120, [1, 2])]
    found = got(frame_of(spark, rows))
    assert found == {120: [(1, 11.0)], 140: [(2, 6.0)]}


def test_empty_tables_and_clashing_columns(spark):
    frame = frame_of(spark, [(0, [1, 0]), (1, [0.5, 0.5])])
    assert hnsw.nearest(frame.limit(0)).count() == 0
    for name in ("id", "q", "dim", "shard", "block", "score"):
        frame = frame.withColumnRenamed("label", name) if "label" in frame.columns else frame.selectExpr("*", f"1 AS {name}")
    assert got(frame) == {0: [(1, 0.5)]}


def test_a_stored_index_serves_other_queries(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(500, 8)).astype(np.float32))]
    frame = frame_of(spark, rows)
    hnsw.build_index(frame).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    asked = frame_of(spark, [(-1, [1, 0, 0, 0, 0, 0, 0, 0])])
    best = [r.vec_id for r in hnsw.search_index(index, asked, k=5, query_rows=1).orderBy("rank").collect()]
    assert best == [i for i, v in sorted(rows, key=lambda r: -r[1][0])[:5]]
