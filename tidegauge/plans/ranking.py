"""Top-k, exact retrieval, abstention and attribution over the embeddings table."""

from pyspark.sql import Window, functions as F

from tidegauge.functions.numbers import fixed
from tidegauge.operators import retrieval, skew
from tidegauge.plans.registry import query
from tidegauge.plans.views import WIDE, FEATURES
from tidegauge.session import materialize


def vectors(t):
    return t.embeddings.select(
        F.col("vec_id").alias("id"), "label",
        retrieval.unit(F.col("embedding").cast("array<double>")).alias("vector"),
    )


VEC = """e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
sim AS (SELECT q.id AS query_id, q.label AS query_label, b.id AS bank_id, b.label AS bank_label,
  list_dot_product(q.v, b.v) AS sim FROM u q JOIN u b ON q.id <> b.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, bank_id) AS rank FROM sim),
top AS (SELECT query_id, query_label, bank_label AS top_label, sim AS top_sim FROM rk WHERE rank = 1),
mg AS (SELECT t.query_id, any_value(t.query_label) AS query_label, any_value(top_label) AS top_label,
  any_value(top_sim) - max(sim) FILTER (bank_label <> top_label) AS margin
  FROM top t JOIN sim s ON s.query_id = t.query_id GROUP BY t.query_id),
fr AS (SELECT query_id, any_value(query_label) AS label,
  min(rank) FILTER (bank_label = query_label) AS first_rank FROM rk GROUP BY query_id)"""


@query("K2_exact_cosine_neighbours", f"""
WITH {VEC} SELECT query_id, bank_id, bank_label, CAST(rank AS BIGINT) AS rank, R6(sim) AS sim FROM rk WHERE rank <= 3""")
def neighbours(t):
    v = vectors(t)
    ranked = retrieval.rank_candidates(retrieval.candidates(v, v, 3)).where("rank <= 3")
    return ranked.select(
        "query_id", "bank_id", "bank_label", F.col("rank").cast("bigint").alias("rank"),
        fixed("sim").alias("sim"),
    )


def margins(t):
    v = vectors(t)
    return retrieval.class_margin(retrieval.candidates(v, v, 1)).join(
        v.select(F.col("id").alias("query_id"), F.col("label").alias("query_label")), "query_id"
    )


@query("K2_class_margin", f"""
WITH {VEC} SELECT query_id, top_label, R6(margin) AS margin FROM mg""")
def class_margin(t):
    return margins(t).select("query_id", "top_label", fixed("margin").alias("margin"))


@query("C11_retrieval_metrics", f"""
WITH {VEC} SELECT label, count(*) AS queries, R6(avg(coalesce(first_rank = 1, false)::INT)) AS hit1,
  R6(avg(coalesce(first_rank <= 3, false)::INT)) AS hit_k, R6(avg(coalesce(1 / first_rank, 0))) AS mrr
FROM fr GROUP BY GROUPING SETS ((), (label))""")
def retrieval_metrics(t):
    v = vectors(t)
    m = retrieval.retrieval_metrics(retrieval.first_relevant_rank(v, v), "label")
    return m.withColumns({c: fixed(c) for c in ("hit1", "hit_k", "mrr")})


ABSTAIN = """a AS (SELECT query_id, R6(margin) AS margin, query_label % 5 <> 0 AS treated,
  top_label = query_label AS correct FROM mg),
g AS (SELECT margin, count(*) FILTER (treated) AS t, count(*) FILTER (NOT treated) AS c,
  count(*) FILTER (treated AND correct) AS k FROM a GROUP BY margin),
cu AS (SELECT margin AS threshold, sum(t) OVER w AS accepted, sum(c) OVER w AS controls,
  sum(k) OVER w AS correct FROM g WINDOW w AS (ORDER BY margin DESC ROWS UNBOUNDED PRECEDING))"""


def _risk_curve(t):
    """One row per distinct margin: rows accepted at or above it, in one sorted pass."""
    m = margins(t).withColumn("margin", fixed("margin"))
    treated = F.col("query_label") % 5 != 0
    right = F.col("top_label") == F.col("query_label")
    # Written once: the sorted pass reads it several times, and each would compare all pairs again.
    g = materialize(m.groupBy("margin").agg(
        F.count_if(treated).alias("_t"), F.count_if(~treated).alias("_c"),
        F.count_if(treated & right).alias("_k"),
    ))
    return skew.running_sum(
        g, [], [F.col("margin").desc()], -F.col("margin"),
        {"accepted": F.col("_t"), "controls": F.col("_c"), "correct": F.col("_k")},
    ).select(F.col("margin").alias("threshold"), "accepted", "controls", "correct")


@query("C10_risk_coverage_curve", f"""
WITH {VEC}, {ABSTAIN} SELECT threshold, CAST(accepted AS BIGINT) AS accepted,
  CAST(controls AS BIGINT) AS controls, CAST(correct AS BIGINT) AS correct FROM cu""")
def risk_curve(t):
    return _risk_curve(t).select(
        "threshold", *[F.col(c).cast("bigint").alias(c) for c in ("accepted", "controls", "correct")]
    )


@query("C10_abstention_threshold", f"""
WITH {VEC}, {ABSTAIN}, n AS (SELECT count(*) FILTER (treated) AS n, max(margin) AS top FROM a),
k AS (SELECT threshold, correct / n AS rate, CASE WHEN accepted > 0 THEN 1 - correct / accepted ELSE 0 END AS risk FROM cu, n
  WHERE controls = 0 UNION ALL SELECT 'infinity'::DOUBLE, 0, 0 FROM n)
SELECT coalesce(nullif(threshold, 'infinity'::DOUBLE), -1) AS threshold, R6(rate) AS rate, R6(risk) AS risk FROM k
WHERE risk <= 0.1 + 1e-12 ORDER BY rate DESC, risk, k.threshold LIMIT 1""")
def abstention(t):
    curve = _risk_curve(t)
    total = vectors(t).agg(F.count_if(F.col("label") % 5 != 0).alias("n"))
    risk = F.when(F.col("accepted") > 0, 1 - F.col("correct") / F.col("accepted")).otherwise(0.0)
    rows = curve.where("controls = 0").crossJoin(F.broadcast(total)).select(
        "threshold", (F.col("correct") / F.col("n")).alias("rate"), risk.alias("risk")
    )
    none = t.spark.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("rate"), F.lit(0.0).alias("risk")
    )
    best = rows.where(F.col("risk") <= 0.1 + 1e-12).unionByName(none).agg(
        F.max_by(
            F.struct("threshold", "rate", "risk"),
            F.struct("rate", -F.col("risk"), -F.col("threshold")),
        ).alias("b")
    )
    return best.select(
        F.when(F.col("b.threshold") < float("inf"), F.col("b.threshold")).otherwise(-1.0).alias("threshold"),
        fixed("b.rate").alias("rate"), fixed("b.risk").alias("risk"),
    )


CENTROIDS = """c AS (SELECT label, list(m ORDER BY p) AS c FROM (SELECT label, p, avg(x) AS m FROM (
  SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY ALL) GROUP BY label),
sc AS (SELECT vec_id AS query_id, e.label AS true_label, c.label AS candidate,
  list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda z: pow(z[1] - z[2], 2))) / len(c) AS score FROM embeddings e, c),
att AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w - score AS margin FROM sc
  WINDOW w AS (PARTITION BY query_id ORDER BY score, candidate))"""


def attributions(t):
    """Every query against every candidate, which are the class means."""
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = e.select("label", F.posexplode("v").alias("p", "x")).groupBy("label", "p").agg(
        F.avg("x").alias("m")
    ).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("c")
    ).withColumnRenamed("label", "candidate")
    score = F.aggregate(
        F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    ) / F.size("c")
    rows = e.crossJoin(means).select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("true_label"), "candidate",
        score.alias("score"),
    )
    w = Window.partitionBy("query_id").orderBy("score", "candidate")
    return rows.withColumn("rank", F.row_number().over(w)).withColumn(
        "margin", F.lead("score").over(w) - F.col("score")
    )


@query("J14_candidate_ranking", f"""
WITH {CENTROIDS} SELECT query_id, candidate, CAST(rank AS BIGINT) AS rank, R6(score) AS score, R6(margin) AS margin FROM att""")
def candidate_ranking(t):
    return attributions(t).select(
        "query_id", "candidate", F.col("rank").cast("bigint").alias("rank"),
        fixed("score").alias("score"), fixed("margin").alias("margin"),
    )


@query("C16_attribution_metrics", f"""
WITH {CENTROIDS}, q AS (SELECT query_id, any_value(true_label) AS true_label,
  bool_or(rank = 1 AND candidate = true_label) AS exact, bool_or(rank = 1 AND candidate % 5 = true_label % 5) AS family,
  bool_or(rank <= 3 AND candidate % 5 = true_label % 5) AS family3, max(margin) FILTER (rank = 1) AS margin FROM att GROUP BY query_id)
SELECT true_label % 5 AS family_id, count(*) AS queries, R6(avg(exact::INT)) AS exact_hit1, R6(avg(family::INT)) AS family_hit1,
  R6(avg(family3::INT)) AS family_hit3, R6(avg(margin)) AS mean_margin FROM q GROUP BY GROUPING SETS ((), (true_label % 5))""")
def attribution_metrics(t):
    same = F.col("candidate") == F.col("true_label")
    kin = F.col("candidate") % 5 == F.col("true_label") % 5
    q = attributions(t).groupBy("query_id", "true_label").agg(
        F.bool_or((F.col("rank") == 1) & same).alias("exact"),
        F.bool_or((F.col("rank") == 1) & kin).alias("family"),
        F.bool_or((F.col("rank") <= 3) & kin).alias("family3"),
        F.max(F.when(F.col("rank") == 1, F.col("margin"))).alias("margin"),
    ).withColumn("family_id", F.col("true_label") % 5)
    avg = lambda c: fixed(F.avg(F.col(c).cast("double")))
    return q.groupingSets([[], ["family_id"]], "family_id").agg(
        F.count(F.lit(1)).alias("queries"), avg("exact").alias("exact_hit1"),
        avg("family").alias("family_hit1"), avg("family3").alias("family_hit3"),
        avg("margin").alias("mean_margin"),
    )


@query("K3_kth_largest_per_row", """
SELECT vec_id, R6(list_reverse_sort(embedding::DOUBLE[])[3]) AS third FROM embeddings""")
def kth_largest(t):
    desc = F.sort_array(F.col("embedding").cast("array<double>"), False)
    return t.embeddings.select("vec_id", fixed(F.get(desc, 2)).alias("third"))


@query("K4_best_record_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY (o_orderstatus = 'F')::INT DESC, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def best_record(t):
    score = F.struct(
        (F.col("o_orderstatus") == "F").cast("int"), "o_totalprice", (-F.col("o_orderkey")).alias("k")
    )
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), score)
    return t.orders.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.*")


@query("K1_top_evidence_at_first_alert", f"""
WITH {WIDE}, fst AS (SELECT run, min(i) AS first_i FROM wide WHERE click + error + purchase + signup + view >= 6 GROUP BY run),
ev AS (UNPIVOT wide ON {', '.join(FEATURES)} INTO NAME feature VALUE n),
b AS (SELECT run, feature, abs(avg(n - 0.5)) AS evidence FROM ev JOIN fst USING (run)
  WHERE i <= first_i AND i > first_i - 6 GROUP BY ALL)
SELECT run, feature, R6(evidence) AS evidence, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY evidence DESC, feature DESC) AS rank FROM b) WHERE rank <= 3""")
def top_evidence(t):
    from tidegauge.operators import detectors

    rows = t.wide.select(
        "run", "i", F.array(*[F.col(f) - F.lit(0.5) for f in FEATURES]).alias("evidence"),
        sum((F.col(f) for f in FEATURES[1:]), F.col(FEATURES[0])).alias("total"),
    )
    first = rows.where("total >= 6").groupBy("run").agg(F.min("i").alias("first_i"))
    out = detectors.top_evidence(rows, first, FEATURES, 6)
    return out.select(
        "run", "feature", fixed("evidence").alias("evidence"), F.col("rank").cast("bigint").alias("rank")
    )


B11_SQL = VEC


@query("B11_retrieval_job_report", f"""
WITH {B11_SQL}, {ABSTAIN}, s AS (SELECT (label % 2) AS role, count(*) AS queries,
  R6(avg((first_rank = 1)::INT)) AS hit1, R6(avg((first_rank <= 3)::INT)) AS hit3 FROM fr GROUP BY 1),
m AS (SELECT query_label % 2 AS role, R6(avg(margin)) AS mean_margin FROM mg GROUP BY 1)
SELECT role, queries, hit1, hit3, mean_margin FROM s JOIN m USING (role)""")
def retrieval_job(t):
    v = vectors(t)
    ranks = retrieval.first_relevant_rank(v, v).groupBy((F.col("label") % 2).alias("role")).agg(
        F.count(F.lit(1)).alias("queries"),
        fixed(F.avg((F.col("first_rank") == 1).cast("int"))).alias("hit1"),
        fixed(F.avg((F.col("first_rank") <= 3).cast("int"))).alias("hit3"),
    )
    m = margins(t).groupBy((F.col("query_label") % 2).alias("role")).agg(
        fixed(F.avg("margin")).alias("mean_margin")
    )
    return ranks.join(m, "role")
