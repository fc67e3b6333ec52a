"""The given tables seen as telemetry, in Spark and in SQL.

events: run = user_id, feature = event_type, time in nanoseconds. Values have two
decimals, so sums are kept as whole cents and stay exact in any order.
"""

from functools import cached_property

from pyspark.sql import functions as F

from tidegauge.functions.clock import micros_of, window_end
from tidegauge.operators import skew, windows
from tidegauge.session import materialize

DAY = 86_400_000_000_000


class Tables:
    """Lazy handles on one folder of parquet tables."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in SCHEMAS:
            raise AttributeError(name)
        table = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = table
        return table

    @cached_property
    def points(self):
        """One gauge point per event; every tenth attribute value flags "no value"."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.events.select(
            F.col("user_id").alias("run"),
            F.col("event_type").alias("feature"),
            (micros_of("ts") * 1000).alias("t"),
            "value",
            F.col("event_id").alias("seq"),
            k.alias("k"),
            F.when(k % 10 == 0, 1).otherwise(0).alias("flags"),
        )

    @cached_property
    def cells(self):
        """Last unflagged value per (run, feature, day)."""
        return windows.last_in_window(
            windows.recorded(self.points), ["run", "feature"], DAY
        )

    @cached_property
    def grid(self):
        """Dense day grid per run with missing cells left NULL."""
        return windows.dense_grid(self.cells, "run", "feature", DAY, FEATURES)

    @cached_property
    def activity(self):
        """Dense (run, day index, feature) with zero-filled count and summed value."""
        return windows.dense_activity(self.points, DAY, FEATURES)

    @cached_property
    def activity_table(self):
        """The activity grid, written once for jobs that read it several times."""
        return materialize(self.activity)

    @cached_property
    def scores(self):
        """Summed activity per (run, day): an exact score for the alert rules."""
        cents = F.round(F.col("value") * 100).cast("bigint")
        end = window_end(F.col("t"), DAY)
        cells = self.points.groupBy("run", end.alias("window_end")).agg(F.sum(cents).alias("c"))
        grid = windows.run_steps(self.points, end, DAY)
        return grid.join(cells, ["run", "window_end"], "left").select(
            "run", "i", (F.coalesce("c", F.lit(0)).cast("double") / 100).alias("score")
        )

    @cached_property
    def wide(self):
        """Activity counts, one column per event type."""
        return (
            self.activity.groupBy("run", "i")
            .pivot("feature", FEATURES)
            .agg(F.first("n"))
        )

    @cached_property
    def counters(self):
        """A cumulative counter per run: restarts each 7 days, new start time each 10."""
        p = self.points.withColumn("life", F.expr(f"t div {7 * DAY}"))
        run = skew.running_sum(
            p, ["run", "life"], ["t", "seq"], F.col("t"), {"total": F.col("k")}
        )
        return run.select(
            "run", "t", "seq", "flags", F.col("total").cast("bigint").alias("total"),
            F.expr(f"(t div {10 * DAY}) * {10 * DAY}").alias("start_t"),
        )

    @cached_property
    def daily_totals(self):
        """Cumulative (count, sum) histogram per supplier and ship day."""
        day = (
            self.lineitem.groupBy(
                F.col("l_suppkey").alias("run"), (micros_of("l_shipdate") * 1000).alias("t")
            )
            .agg(
                F.count(F.lit(1)).alias("c"),
                F.sum(F.col("l_quantity").cast("bigint")).alias("q"),
            )
        )
        return skew.running_sum(
            day, ["run"], ["t"], F.col("t"),
            {"hist_count": F.col("c"), "hist_sum": F.col("q")},
        ).select(
            "run", "t", F.col("hist_count").cast("bigint"), F.col("hist_sum").cast("double")
        )

    @cached_property
    def scores_table(self):
        """The scores, written once for jobs that read them several times."""
        return materialize(self.scores)


# Schemas are declared, never inferred.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# The event types of the given events table.
FEATURES = ["click", "error", "purchase", "signup", "view"]

PTS = """pts AS (
  SELECT user_id AS run, event_type AS feature, epoch_us(ts) * 1000 AS t, value,
         event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0
              THEN 1 ELSE 0 END AS flags
  FROM events)"""

WE = f"((t + {DAY} - 1) // {DAY}) * {DAY}"

CELLS = PTS + f""", cells AS (
  SELECT run, feature, {WE} AS window_end, arg_max(value, t * 100000000::HUGEINT + seq) AS value
  FROM pts WHERE flags = 0 GROUP BY ALL)"""

GRID = CELLS + f""", lims AS (
  SELECT run, min(window_end) AS lo, max(window_end) AS hi FROM cells GROUP BY run),
grid AS (
  SELECT r.run, f.feature, r.window_end, c.value, c.value IS NOT NULL AS observed
  FROM (SELECT run, unnest(range(lo, hi + 1, {DAY})) AS window_end FROM lims) r
  CROSS JOIN (SELECT DISTINCT feature FROM cells) f
  LEFT JOIN cells c USING (run, feature, window_end))"""

ACT = PTS + f""", ends AS (
  SELECT run, feature, {WE} AS we, CAST(round(value * 100) AS BIGINT) AS cents FROM pts),
span AS (SELECT min(we) AS lo, max(we) AS hi FROM ends),
agg AS (SELECT run, feature, (we - lo) // {DAY} AS i, count(*) AS n, sum(cents) AS cents
        FROM ends, span GROUP BY ALL),
act AS (
  SELECT r.run, f.feature, d.i, coalesce(a.n, 0) AS n,
         CAST(coalesce(a.cents, 0) AS DOUBLE) / 100 AS value
  FROM (SELECT DISTINCT run FROM ends) r CROSS JOIN (SELECT DISTINCT feature FROM ends) f
  CROSS JOIN (SELECT unnest(range(0, (hi - lo) // {DAY} + 1)) AS i FROM span) d
  LEFT JOIN agg a ON a.run = r.run AND a.feature = f.feature AND a.i = d.i)"""

WIDE = ACT + ", wide AS (SELECT run, i, " + ", ".join(
    f"CAST(max(n) FILTER (feature = '{f}') AS BIGINT) AS {f}" for f in FEATURES
) + " FROM act GROUP BY run, i)"

COUNTERS = PTS + f""", counters AS (
  SELECT run, t, seq, flags,
         CAST(sum(k) OVER (PARTITION BY run, t // {7 * DAY} ORDER BY t, seq
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total,
         (t // {10 * DAY}) * {10 * DAY} AS start_t
  FROM pts)"""

TOTALS = """daily AS (
  SELECT l_suppkey AS run, epoch_us(l_shipdate) * 1000 AS t, count(*) AS c,
         sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
totals AS (
  SELECT run, t, CAST(sum(c) OVER w AS BIGINT) AS hist_count, sum(q) OVER w AS hist_sum
  FROM daily WINDOW w AS (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING))"""

SCORES = PTS + f""", ends AS (
  SELECT run, {WE} AS we, CAST(round(value * 100) AS BIGINT) AS cents FROM pts),
span AS (SELECT min(we) AS lo, max(we) AS hi FROM ends),
agg AS (SELECT run, (we - lo) // {DAY} AS i, sum(cents) AS cents FROM ends, span GROUP BY ALL),
scores AS (
  SELECT r.run, d.i, CAST(coalesce(a.cents, 0) AS DOUBLE) / 100 AS score
  FROM (SELECT DISTINCT run FROM ends) r
  CROSS JOIN (SELECT unnest(range(0, (hi - lo) // {DAY} + 1)) AS i FROM span) d
  LEFT JOIN agg a ON a.run = r.run AND a.i = d.i)"""
