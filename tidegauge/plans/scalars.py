"""Scalar functions over the given tables."""

from pyspark.sql import functions as F

from tidegauge.functions import attributes, hashing, numbers, text
from tidegauge.functions.numbers import fixed
from tidegauge.plans.registry import query


@query("X1_normalized_bodies")
def normalized(t):
    body = text.normalize_body(F.col("text"))
    return t.documents.select("doc_id", F.md5(body).alias("body_md5"), F.length(body).alias("n"))


@query("X2_template_key", """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'event:' || event_type
  ELSE 'body:' || regexp_replace(lower(props), '[0-9]+', '<num>', 'g') END AS template FROM events""")
def template_key(t):
    name = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" "), "event_type")).otherwise("  ")
    return t.events.select("event_id", text.template_key(name, F.col("props")).alias("template"))


@query("X3_canonical_identity", """
SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS id FROM orders""")
def identity(t):
    return t.orders.select(
        "o_orderkey", hashing.identity(["o_orderkey", "o_orderstatus", "o_custkey"]).alias("id")
    )


@query("X4_derived_integers", """
SELECT o_orderkey, CAST(d % 1000003 AS BIGINT) AS reduced, CAST(5 + d % 16 AS BIGINT) AS draw FROM (
  SELECT o_orderkey, CAST('0x' || substr(sha256('42:' || o_orderkey), 1, 16) AS UBIGINT) AS d FROM orders)""")
def derived(t):
    d = hashing.derived_integer(42, F.col("o_orderkey"))
    return t.orders.select(
        "o_orderkey", (d % F.lit(1000003).cast("decimal(20,0)")).cast("bigint").alias("reduced"),
        hashing.bounded_draw(42, F.col("o_orderkey"), 5, 20).alias("draw"),
    )


@query("X5_family_id", """
SELECT c_custkey, 'f' || lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0') AS family FROM customer""")
def family(t):
    case = F.concat(F.lit("case-f"), (F.col("c_custkey") % 40).cast("string"), F.lit("-"), "c_name")
    number = F.regexp_extract(case, r"-f([0-9]+)-", 1)
    return t.customer.select("c_custkey", F.concat(F.lit("f"), F.lpad(number, 2, "0")).alias("family"))


@query("X7_binomial_bounds", """
WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS k FROM events GROUP BY 1)
SELECT user_id, R9(1 - pow(0.05, 1.0 / n)) AS zero_event_bound,
  R9((SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.2) + (n - j) * ln(0.8))) FROM range(0, n + 1) x(j) WHERE j <= k)) AS lower_tail FROM g""")
def binomial(t):
    g = t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("k")
    )
    n = F.col("n").cast("double")
    return g.select(
        "user_id", fixed(numbers.zero_event_upper_bound(n), 9).alias("zero_event_bound"),
        fixed(numbers.binomial_lower_tail(F.col("k"), n, F.lit(0.2)), 9).alias("lower_tail"),
    )


@query("X8_random_hit_at_k", """
WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS a FROM events GROUP BY 1)
SELECT user_id, R9(1 - greatest(n - a, 0) * greatest(n - a - 1, 0) * greatest(n - a - 2, 0) / (n * (n - 1.0) * (n - 2))) AS hit_at_3 FROM g WHERE n >= 3""")
def random_hit(t):
    g = t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("a")
    ).where("n >= 3")
    return g.select("user_id", fixed(numbers.random_hit_at_k(F.col("n"), F.col("a"), 3), 9).alias("hit_at_3"))


@query("X9_pinball_and_rmse", """
SELECT l_returnflag, R6(avg(greatest(0.9 * (l_quantity - 25), -0.1 * (l_quantity - 25)))) AS pinball,
  R6(sqrt(avg(pow(l_quantity - 25, 2)))) AS rmse FROM lineitem GROUP BY 1""")
def pinball(t):
    e = F.col("l_quantity") - 25
    return t.lineitem.groupBy("l_returnflag").agg(
        fixed(F.avg(numbers.pinball(F.lit(25.0), F.col("l_quantity"), 0.9))).alias("pinball"),
        fixed(F.sqrt(F.avg(e * e))).alias("rmse"),
    )


@query("X10_mixture_weights_and_centering", """
WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS a, embedding::DOUBLE[] AS r FROM embeddings),
w AS (SELECT vec_id, r, list_transform(a, lambda x: 0.001 + (1 - 0.001 * len(a)) * x / list_sum(a)) AS w FROM e),
c AS (SELECT vec_id, r, w, list_sum(list_transform(list_zip(w, r), lambda z: z[1] * z[2])) AS m FROM w)
SELECT vec_id, R6(list_min(w)) AS smallest, R6(list_max(w)) AS largest, R6(m) AS shift, R6(r[1] - m) AS first_centered FROM c""")
def mixture_weights(t):
    r = F.col("embedding").cast("array<double>")
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    e = t.embeddings.select("vec_id", r.alias("r"), F.transform(r, lambda x: F.abs(x)).alias("a"))
    w = e.withColumn("_t", total).withColumn(
        "w", F.transform("a", lambda x: 0.001 + (1 - 0.001 * F.size("a")) * x / F.col("_t"))
    )
    head = F.slice("w", F.lit(1), F.size("w") - 1)
    w = w.withColumn("w", F.array_append(head, 1 - F.aggregate(head, F.lit(0.0), lambda s, x: s + x)))
    m = F.aggregate(F.zip_with("w", "r", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    c = w.withColumn("m", m)
    return c.select(
        "vec_id", fixed(F.array_min("w")).alias("smallest"), fixed(F.array_max("w")).alias("largest"),
        fixed("m").alias("shift"), fixed(F.get("r", 0) - F.col("m")).alias("first_centered"),
    )


@query("S4_typed_attributes", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k_int, '"' || event_type || '"' AS kind,
  CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, 3 AS keys FROM events""")
def typed_attributes(t):
    none = {f: F.lit(None).cast("string") for f in attributes.VALUE_FIELDS}
    none |= {"boolValue": F.lit(None).cast("boolean"), "doubleValue": F.lit(None).cast("double")}

    def entry(key, **value):
        return F.struct(F.lit(key).alias("key"), F.struct(
            *[(value[f] if f in value else none[f]).alias(f) for f in attributes.VALUE_FIELDS]
        ).alias("value"))

    k = F.get_json_object("props", "$.k")
    entries = F.array(
        entry("kind", stringValue=F.col("event_type")),
        entry("flag", boolValue=F.col("user_id") % 2 == 0),
        entry("k", intValue=F.when(F.col("event_id") % 2 == 0, k),
              doubleValue=F.when(F.col("event_id") % 2 == 1, F.col("value"))),
    )
    m = t.events.select("event_id", attributes.attribute_map(entries).alias("m"))
    whole = F.when(F.col("event_id") % 2 == 0, F.col("m")["k"])
    return m.select(
        "event_id", whole.alias("k_int"), F.col("m")["kind"].alias("kind"), F.col("m")["flag"].alias("flag"),
        F.size("m").cast("bigint").alias("keys"),
    )


@query("S5_oneof_numbers", """
SELECT event_id, CASE WHEN k % 3 = 0 THEN k END AS int_value, CASE WHEN k % 3 = 1 THEN value END AS double_value,
  k % 3 < 2 OR k % 2 = 1 AS number_ok FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def oneof(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    point = F.struct(
        F.when(k % 3 == 0, k.cast("string")).alias("asInt"),
        F.when(k % 3 == 1, F.col("value")).alias("asDouble"),
        (k % 2).cast("int").alias("flags"),
    )
    rows = t.events.select("event_id", point.alias("p"))
    as_int, as_double, ok = attributes.number_fields(F.col("p"))
    return rows.select("event_id", as_int.alias("int_value"), as_double.alias("double_value"), ok.alias("number_ok"))
