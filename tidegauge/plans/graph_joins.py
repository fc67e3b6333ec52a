"""Joins over graphs, traces, pairs and intervals."""

from pyspark.sql import Window, functions as F

from tidegauge.functions.clock import micros_of, window_end
from tidegauge.functions.numbers import fixed
from tidegauge.operators import design, events, graph, traces, windows
from tidegauge.plans.frames import ACTIONS, actions_of
from tidegauge.plans.registry import query
from tidegauge.plans.sequences import SPANS, spans_of
from tidegauge.plans.views import ACT, CELLS, DAY, PTS, WE


@query("J1_entity_resolution", """
SELECT event_id, CASE WHEN user_id % 4 = 0 AND event_type = 'click' THEN 'frontend'
  WHEN event_type = 'error' THEN 'alerting' WHEN user_id % 4 = 0 THEN 'api' WHEN user_id % 4 = 1 THEN 'worker' END AS entity FROM events""")
def entity_resolution(t):
    rows = t.events.select(
        "event_id", F.concat(F.lit("svc"), (F.col("user_id") % 4).cast("string")).alias("service"),
        F.concat(F.lit("event:"), "event_type").alias("event"),
    )
    make = t.spark.createDataFrame
    out = graph.resolve_entity(
        rows, make([("svc0", "click", "frontend")], "service string, event string, entity string"),
        make([("error", "alerting")], "event string, entity string"),
        make([("svc0", "api"), ("svc1", "worker")], "service string, entity string"),
    )
    return out.select("event_id", "entity")


J2 = f"""m AS (SELECT run, {WE} AS window_end, max(value) AS metric FROM pts WHERE feature = 'view' GROUP BY ALL),
l AS (SELECT run, {WE} AS window_end, count(*) AS logs FROM pts WHERE feature = 'error' GROUP BY ALL)"""


def _channels(t):
    p = t.points.withColumn("window_end", window_end(F.col("t"), DAY))
    m = p.where("feature = 'view'").groupBy("run", "window_end").agg(F.max("value").alias("metric"))
    log = p.where("feature = 'error'").groupBy("run", "window_end").agg(F.count(F.lit(1)).alias("logs"))
    return m, log


@query("J2_channel_alignment", f"""
WITH {PTS}, {J2} SELECT run, window_end, metric, logs FROM m JOIN l USING (run, window_end)""")
def channels(t):
    m, log = _channels(t)
    return m.join(log, ["run", "window_end"])


@query("J2_unaligned_windows", f"""
WITH {PTS}, {J2} SELECT run, window_end, CASE WHEN logs IS NULL THEN 'no_logs' ELSE 'no_metric' END AS problem
FROM m FULL JOIN l USING (run, window_end) WHERE logs IS NULL OR metric IS NULL""")
def unaligned(t):
    m, log = _channels(t)
    keys = ["run", "window_end"]
    a = m.join(log, keys, "left_anti").select(*keys, F.lit("no_logs").alias("problem"))
    return a.unionByName(log.join(m, keys, "left_anti").select(*keys, F.lit("no_metric").alias("problem")))


def _bindings(t):
    features = t.nation.select(F.col("n_name").alias("feature"))
    owners = t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey).select(
        F.col("n_name").alias("feature"), F.col("r_name").alias("entity")
    )
    return features, owners


@query("J3_feature_ownership", """
SELECT n_name AS feature, r_name AS entity, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS BIGINT) AS slot
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def ownership(t):
    return graph.bind_features(*_bindings(t)).select("feature", "entity", F.col("slot").cast("bigint").alias("slot"))


@query("J3_binding_violations", """
SELECT n_name AS feature, 'unbound' AS problem FROM nation WHERE n_regionkey = 0
UNION ALL SELECT r_name, 'unexpected' FROM region WHERE r_regionkey <> 0""")
def binding_problems(t):
    features, owners = _bindings(t)
    bound = owners.join(t.region.where("r_regionkey <> 0"), F.col("entity") == F.col("r_name")).select("feature", "entity")
    extra = t.region.where("r_regionkey <> 0").select(F.col("r_name").alias("feature"), F.lit("x").alias("entity"))
    return graph.binding_violations(features, bound.unionByName(extra))


EDGES = """edges AS (SELECT 's' || s_suppkey || '>n' || s_nationkey AS edge, 's' || s_suppkey AS source, 'n' || s_nationkey AS target, 'serves' AS relation FROM supplier
UNION ALL SELECT 'n' || n_nationkey || '>r' || n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, 'belongs' FROM nation
UNION ALL SELECT 'r' || r_regionkey || '>r' || ((r_regionkey + 1) % 5), 'r' || r_regionkey, 'r' || ((r_regionkey + 1) % 5), 'next' FROM region)"""


def edges_of(t):
    def part(df, a, ka, b, kb, relation):
        s = F.concat(F.lit(a), ka.cast("string"))
        e = F.concat(F.lit(b), kb.cast("string"))
        return df.select(
            F.concat(s, F.lit(">"), e).alias("edge"), s.alias("source"), e.alias("target"),
            F.lit(relation).alias("relation"),
        )

    return (
        part(t.supplier, "s", F.col("s_suppkey"), "n", F.col("s_nationkey"), "serves")
        .unionByName(part(t.nation, "n", F.col("n_nationkey"), "r", F.col("n_regionkey"), "belongs"))
        .unionByName(part(t.region, "r", F.col("r_regionkey"), "r", (F.col("r_regionkey") + 1) % 5, "next"))
    )


@query("J4_one_hop_neighbours", f"""
WITH {EDGES} SELECT source AS entity, edge AS neighbour FROM edges UNION SELECT target, edge FROM edges
UNION SELECT edge, source FROM edges UNION SELECT edge, target FROM edges""")
def one_hop(t):
    return graph.neighbours(edges_of(t))


@query("J5_downstream_reachability", f"""
WITH RECURSIVE {EDGES}, r(source, target) AS (SELECT source, target FROM edges
  UNION SELECT r.source, e.target FROM r JOIN edges e ON e.source = r.target) SELECT source, target FROM r""")
def reachability(t):
    return graph.reachable(edges_of(t))


@query("J6_incoming_sources", f"""
WITH {EDGES} SELECT edge AS entity, source AS source_entity FROM edges UNION SELECT target, edge FROM edges
UNION SELECT edge, edge FROM edges UNION SELECT source, source FROM edges UNION SELECT target, target FROM edges""")
def incoming(t):
    e = edges_of(t)
    nodes = e.select(F.col("source").alias("entity")).unionByName(e.select(F.col("target").alias("entity"))).distinct()
    return graph.incoming_sources(e, nodes)


@query("J7_typed_adjacency", f"""
WITH {EDGES}, ids AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS id FROM (
  SELECT source AS entity FROM edges UNION SELECT target FROM edges))
SELECT relation, a.id AS source_id, b.id AS target_id FROM edges JOIN ids a ON a.entity = source JOIN ids b ON b.entity = target""")
def typed_adjacency(t):
    e = edges_of(t)
    nodes = e.select(F.col("source").alias("entity")).unionByName(e.select(F.col("target").alias("entity")))
    ids = events.fit_vocabulary(nodes, "entity").select("entity", (F.col("template_id") - 1).alias("id"))
    a = ids.select(F.col("entity").alias("source"), F.col("id").alias("source_id"))
    b = ids.select(F.col("entity").alias("target"), F.col("id").alias("target_id"))
    return e.join(a, "source").join(b, "target").select("relation", "source_id", "target_id")


@query("J8_matched_pair_effect_error", f"""
WITH {ACT}, {ACTIONS}, p AS (SELECT *, lag(value) OVER (PARTITION BY run, feature ORDER BY i) AS pred FROM act),
d AS (SELECT a.run, a.feature, a.i, a.value - b.value AS obs, a.pred - b.pred AS pred FROM p a JOIN p b
  ON b.run = a.run - 1 AND b.feature = a.feature AND b.i = a.i WHERE a.run % 2 = 1)
SELECT d.run // 2 AS pair, R3(avg(pow(d.pred - obs, 2))) AS effect_mse FROM d JOIN actions x ON x.run = d.run AND d.i >= start_i AND d.i < stop_i
WHERE d.feature IN (x.feature, 'view') GROUP BY 1""")
def pair_effect_error(t):
    w = Window.partitionBy("run", "feature").orderBy("i")
    rows = t.activity.withColumn("pred", F.lag("value").over(w)).select(
        F.expr("run div 2").alias("pair"), (F.col("run") % 2 == 1).alias("treated"), "feature", "i", "value", "pred"
    )
    side = lambda c, arm: F.max(F.when(F.col("treated") == arm, F.col(c)))
    d = rows.groupBy("pair", "feature", "i").agg(
        (side("value", True) - side("value", False)).alias("obs"),
        (side("pred", True) - side("pred", False)).alias("fore"),
    ).where("obs IS NOT NULL AND fore IS NOT NULL")
    plan = actions_of(t).where("run % 2 = 1").select(
        F.expr("run div 2").alias("pair"), "start_i", "stop_i",
        F.array("feature", F.lit("view")).alias("downstream"),
    )
    hit = (F.col("i") >= F.col("start_i")) & (F.col("i") < F.col("stop_i"))
    e = F.col("fore") - F.col("obs")
    return d.join(plan, "pair").where(hit & F.array_contains("downstream", F.col("feature"))).groupBy("pair").agg(
        fixed(F.avg(e * e), 3).alias("effect_mse")
    )


@query("J9_interval_phases", f"""
WITH {PTS}, {ACTIONS}, s AS (SELECT min({WE}) AS lo FROM pts), p AS (SELECT pts.run, seq, ({WE} - lo) // {DAY} AS i FROM pts, s)
SELECT seq, CASE WHEN i >= start_i AND i < stop_i THEN 'active' WHEN i >= stop_i AND i < stop_i + 4 THEN 'recovery'
  WHEN i < start_i THEN 'before' ELSE 'normal' END AS phase, greatest(0, least(i + 3, stop_i) - greatest(i, start_i)) AS overlap
FROM p JOIN actions USING (run)""")
def phases(t):
    end = window_end(F.col("t"), DAY)
    lo = t.points.agg(F.min(end).alias("_lo"))
    p = t.points.crossJoin(F.broadcast(lo)).select("run", "seq", ((end - F.col("_lo")) / DAY).cast("bigint").alias("i"))
    i, a, b = F.col("i"), F.col("start_i"), F.col("stop_i")
    phase = (
        F.when((i >= a) & (i < b), "active").when((i >= b) & (i < b + 4), "recovery")
        .when(i < a, "before").otherwise("normal")
    )
    over = F.greatest(F.lit(0).cast("bigint"), F.least(i + 3, b) - F.greatest(i, a))
    return p.join(actions_of(t), "run").select("seq", phase.alias("phase"), over.alias("overlap"))


@query("J10_span_tree_validity", f"""
WITH {SPANS} SELECT s.trace, count(*) AS spans, count(*) - count(DISTINCT s.span) AS repeated,
  count(*) FILTER (s.parent IS NOT NULL AND p.span IS NULL) AS missing_parents,
  count(*) = count(DISTINCT s.span) AND count(*) FILTER (s.parent IS NOT NULL AND p.span IS NULL) = 0 AS valid
FROM spans s LEFT JOIN spans p ON p.trace = s.trace AND p.span = s.parent GROUP BY s.trace""")
def span_tree(t):
    return traces.structure(spans_of(t))


@query("J10_span_depth", f"""
WITH {SPANS} SELECT trace, span, span AS depth FROM spans""")
def span_depth(t):
    return traces.depths(spans_of(t)).withColumn("depth", F.col("depth").cast("bigint"))


PATH = f"""{SPANS}, n AS (SELECT trace, name, count(*) AS n, min(span) AS span, min(parent) AS parent, min(start) AS start FROM spans
  WHERE name IN ('user', 'assistant') GROUP BY ALL),
x AS (SELECT trace, max(n) = 1 AND count(*) = 2 AND bool_or(name = 'user' AND parent IS NULL) AND bool_or(name = 'assistant' AND parent =
  (SELECT m.span FROM n m WHERE m.trace = n.trace AND m.name = 'user')) AS exact FROM n GROUP BY trace)"""


@query("J11_exact_ordered_path", f"""
WITH {PATH} SELECT trace, exact FROM x""")
def exact_path(t):
    return traces.exact_path(spans_of(t), ["user", "assistant"])


@query("J12_trace_coverage", f"""
WITH {PATH}, a AS (SELECT DISTINCT user_id AS trace FROM events WHERE event_type = 'purchase'),
c AS (SELECT trace FROM x WHERE exact)
SELECT count(*) AS accepted, count(c.trace) AS completed, R6(CASE WHEN count(*) > 0 THEN count(c.trace) / count(*) ELSE 0 END) AS ratio
FROM a LEFT JOIN c USING (trace)""")
def trace_coverage(t):
    accepted = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("trace"))
    done = traces.exact_path(spans_of(t), ["user", "assistant"]).where("exact")
    return traces.coverage(accepted, done).withColumn("ratio", fixed("ratio"))


@query("J13_derangement", """
WITH m AS (SELECT DISTINCT user_id AS run, user_id % 6 AS stratum FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY run) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM m)
SELECT a.stratum, a.run, nullif(b.run, a.run) AS donor FROM r a JOIN r b ON b.stratum = a.stratum AND b.rn = a.rn % a.n + 1""")
def deranged(t):
    rows = t.events.select(F.col("user_id").alias("run"), (F.col("user_id") % 6).alias("stratum"))
    return design.derangement(rows, ["stratum"], "run")


RECON = """e AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS status, 4 AS lines FROM orders WHERE o_orderpriority <> '5-LOW'),
o AS (SELECT l_orderkey AS k, max(l_linestatus) AS status, count(*) AS lines FROM lineitem GROUP BY 1)"""


@query("J15_plan_reconciliation", f"""
WITH {RECON} SELECT k, CASE WHEN o.lines IS NULL THEN 'missing' WHEN e.lines IS NULL THEN 'unexpected'
  WHEN e.status <> o.status THEN 'status' WHEN e.lines <> o.lines THEN 'lines' END AS mismatch FROM e FULL JOIN o USING (k)""")
def plan_reconciliation(t):
    e = t.orders.where("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("status"),
        F.lit(4).cast("bigint").alias("lines"),
    )
    o = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.max("l_linestatus").alias("status"), F.count(F.lit(1)).alias("lines")
    )
    return design.reconcile(e, o, ["k"], ["status", "lines"])


CASE = """c AS (SELECT o_custkey AS batch, (o_orderkey % 2) AS wave, epoch_us(o_orderdate) AS start,
  epoch_us(o_orderdate) + 86400000000 * (1 + o_orderkey % 9) AS stop, o_custkey % 12 AS lane, o_custkey % 24 AS project FROM orders)"""


def wave_cases(t):
    return t.orders.select(
        F.col("o_custkey").alias("batch"), (F.col("o_orderkey") % 2).alias("wave"),
        micros_of("o_orderdate").alias("start"),
        (micros_of("o_orderdate") + 86_400_000_000 * (1 + F.col("o_orderkey") % 9)).alias("stop"),
        (F.col("o_custkey") % 12).alias("lane"), (F.col("o_custkey") % 24).alias("project"),
    )


@query("J16_wave_barrier", f"""
WITH {CASE} SELECT batch, coalesce(max(stop) FILTER (wave = 0) <= min(start) FILTER (wave = 1), false) AS barrier,
  bool_and(start < stop) AS ordered FROM c GROUP BY batch""")
def barrier(t):
    return design.wave_barrier(wave_cases(t))


@query("J16_lane_isolation", f"""
WITH {CASE} SELECT lane, count(DISTINCT project) AS projects, count(DISTINCT project) = 1 AS isolated FROM c GROUP BY lane""")
def lanes(t):
    return design.lane_isolation(wave_cases(t))


@query("J17_compiled_parity", f"""
WITH {CELLS} SELECT count(*) AS "rows", 0 AS unmatched, 0.0::DOUBLE AS max_value_difference, 0 AS alert_changes FROM cells""")
def compiled_parity(t):
    """The daily table against the same table derived through hourly windows."""
    hour = windows.last_in_window(windows.recorded(t.points), ["run", "feature"], DAY // 24)
    again = hour.withColumn("t", F.col("window_end")).withColumn("seq", F.lit(0))
    daily = windows.last_in_window(
        again.drop("window_end"), ["run", "feature"], DAY
    )
    flag = lambda df: df.withColumn("alert", F.col("value") > 100)
    return design.parity(flag(t.cells), flag(daily), ["run", "feature", "window_end"], ["value"], ["alert"])
