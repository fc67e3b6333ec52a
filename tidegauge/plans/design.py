"""Set operators and design checks."""

from pyspark.sql import functions as F

from tidegauge.functions.hashing import derived_integer
from tidegauge.functions.numbers import fixed
from tidegauge.operators import design, sketch, skew
from tidegauge.plans.frames import SERIES, frames_of
from tidegauge.plans.registry import query
from tidegauge.plans.views import ACT


@query("O1_concatenate_frames", f"""
WITH {ACT}, f AS (SELECT run, feature, i, value AS target, lag(value, 6) OVER (PARTITION BY run, feature ORDER BY i) AS c0 FROM act)
SELECT run, feature, i, target, c0, run % 2 AS part FROM f WHERE i >= 6""")
def concatenated(t):
    f = frames_of(t).select(*SERIES, "i", "target", F.get("context", 0).alias("c0"))
    a = f.where("run % 2 = 0").withColumn("part", F.lit(0).cast("bigint"))
    return a.unionByName(f.where("run % 2 = 1").withColumn("part", F.lit(1).cast("bigint")))


@query("O2_split_overlap", """
WITH r AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'reserved' WHEN o_custkey % 5 = 0 THEN 'validation' ELSE 'training' END AS role FROM orders)
SELECT id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM r GROUP BY id HAVING count(DISTINCT role) > 1""")
def split_overlap(t):
    role = F.when(F.col("o_orderkey") % 50 == 0, "reserved").when(
        F.col("o_custkey") % 5 == 0, "validation"
    ).otherwise("training")
    out = design.overlaps(t.orders.select(F.col("o_custkey").alias("id"), role.alias("role")))
    return out.select("id", F.array_join("roles", ",").alias("roles"))


@query("O2_missing_declared_ids", """
SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def missing_ids(t):
    return t.customer.select(F.col("c_custkey").alias("id")).join(
        t.orders.select(F.col("o_custkey").alias("id")), "id", "left_anti"
    )


@query("O3_factorial_balance", """
WITH c AS (SELECT p.o_orderpriority, s.o_orderstatus FROM (SELECT DISTINCT o_orderpriority FROM orders) p, (SELECT DISTINCT o_orderstatus FROM orders) s),
n AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, o_orderstatus, coalesce(n, 0) AS n, coalesce(n, 0) = 1000 AS balanced FROM c LEFT JOIN n USING (o_orderpriority, o_orderstatus)""")
def balance(t):
    return design.factorial_balance(t.orders, ["o_orderpriority", "o_orderstatus"], 1000)


@query("O4_lineage_role_conflicts", """
WITH r AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'train' ELSE 'test' END AS role, o_custkey % 400 AS campaign,
  o_orderpriority AS stack, [o_orderkey // 2, o_orderkey % 7] AS f FROM orders),
x AS (SELECT role, 'campaign' AS kind, CAST(campaign AS VARCHAR) AS id FROM r UNION ALL SELECT role, 'stack', stack FROM r
  UNION ALL SELECT role, 'fingerprint', CAST(unnest(f) AS VARCHAR) FROM r)
SELECT kind, id, count(DISTINCT role) AS roles FROM x GROUP BY ALL HAVING count(DISTINCT role) > 1""")
def conflicts(t):
    k = F.col("o_orderkey")
    records = t.orders.select(
        F.when(k % 3 == 0, "train").otherwise("test").alias("role"),
        F.when(k % 2 == 0, F.col("o_custkey") % 400).alias("source_campaign"),
        (F.col("o_custkey") % 400).alias("campaign"), F.col("o_orderpriority").alias("stack"),
        F.array(F.expr("o_orderkey div 2"), k % 7).alias("fingerprints"),
    )
    return design.role_conflicts(records)


@query("O5_factorial_design_plan", """
WITH f AS (SELECT p.v AS priority, s.v AS status, r AS replicate FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) p,
  (SELECT DISTINCT o_orderstatus AS v FROM orders) s, range(0, 4) x(r)),
k AS (SELECT *, priority || ':' || status || ':' || replicate AS key FROM f),
h AS (SELECT *, CAST('0x' || substr(sha256('11:' || key || ':workload'), 1, 16) AS UBIGINT) % 1000000 AS workload_seed,
  sha256('11:permutation:' || key) AS ord FROM k)
SELECT priority, status, CAST(replicate AS BIGINT) AS replicate, CAST(workload_seed AS BIGINT) AS workload_seed,
  row_number() OVER (ORDER BY ord) AS position FROM h""")
def design_plan(t):
    cells = t.orders.select(F.col("o_orderpriority").alias("priority")).distinct().crossJoin(
        t.orders.select(F.col("o_orderstatus").alias("status")).distinct()
    ).withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    key = F.concat_ws(":", "priority", "status", F.col("replicate").cast("string"))
    rows = cells.withColumn("key", key).withColumn(
        "workload_seed",
        (derived_integer(11, F.concat("key", F.lit(":workload"))) % F.lit(1000000).cast("decimal(20,0)")).cast("bigint"),
    ).withColumn("ord", F.sha2(F.concat(F.lit("11:permutation:"), "key"), 256))
    by = F.conv(F.substring("ord", 1, 12), 16, 10).cast("bigint")
    return skew.running_count(rows, [], ["ord"], by, "position").drop("key", "ord")


@query("O6_truth_leak_scan", """
SELECT event_id FROM events WHERE contains(lower(props), '"fault')
  OR user_id % 9 = 0 AND event_type = 'error'""")
def leak_scan(t):
    payload = F.to_json(F.struct(
        F.from_json("props", "map<string,bigint>").alias("attributes"),
        F.when(F.col("user_id") % 9 == 0, F.struct(F.col("event_type").alias("note"))).alias("nested"),
    ))
    rows = t.events.select("event_id", payload.alias("payload"))
    return design.leaks(rows, "payload", ["fault", "ground_truth"], ["error"]).select("event_id")


@query("O6_document_key_scan", """
SELECT doc_id FROM documents WHERE source IN ('src3', 'src7')""")
def document_scan(t):
    rows = t.documents.select("doc_id", F.to_json(F.struct("text", "lang", "source")).alias("payload"))
    return design.leaks(rows, "payload", ["ground_truth"], ["src3", "src7"]).select("doc_id")


SKETCH = """e AS (SELECT user_id, sum(value) AS exact FROM events GROUP BY 1),
b AS (SELECT user_id, exact, r, ('0x' || substr(sha256('5:' || r || ':' || user_id), 1, 16))::UBIGINT % 256 AS bucket FROM e, range(4) x(r)),
s AS (SELECT user_id, exact, sum(exact) OVER (PARTITION BY r, bucket) AS total FROM b),
k AS (SELECT user_id, any_value(exact) AS exact, min(total) AS estimate FROM s GROUP BY user_id)"""


@query("A7_count_min_sketch", f"""
WITH {SKETCH} SELECT user_id, R4(exact) AS exact, R4(estimate) AS estimate, estimate - exact >= -1e-6 AS never_under FROM k""")
def count_min(t):
    r = sketch.error_report(t.events, "user_id", "value", width=256, depth=4, seed=5)
    return r.select(
        "user_id", fixed("exact", 4).alias("exact"), fixed("estimate", 4).alias("estimate"),
        (F.col("excess") >= -1e-6).alias("never_under"),
    )


@query("A7_sketch_summary", f"""
WITH {SKETCH} SELECT count(*) AS keys, count(*) FILTER (abs(estimate - exact) < 1e-6) AS exact_keys, R4(avg(estimate - exact)) AS mean_excess,
  R4(max(estimate - exact)) AS max_excess, CAST(8192 AS INT) AS sketch_bytes FROM k""")
def sketch_summary(t):
    """Keys, keys met without collision, mean and largest excess, cells and bytes."""
    r = sketch.error_report(t.events, "user_id", "value", width=256, depth=4, seed=5)
    return r.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.abs("excess") < 1e-6).alias("exact_keys"),
        fixed(F.avg("excess"), 4).alias("mean_excess"), fixed(F.max("excess"), 4).alias("max_excess"),
        F.lit(256 * 4 * 8).alias("sketch_bytes"),
    )
