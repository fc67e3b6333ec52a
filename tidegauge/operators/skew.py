"""Ordered work per key that holds when one key has most of the rows.

A window over ``PARTITION BY key ORDER BY t`` puts a whole key in one task.
Here a key whose row count passes a limit is *split*: its rows are cut into
slots along the order column, each slot is scanned on its own, and what a slot
has to know about the slots before it (a sum, a minimum, a last value) is
carried over from one summary row per slot. Results equal the plain window.

The limit is ``max(tidegauge.maxGroupRows, rows / shuffle partitions)``, so at
most as many keys as there are shuffle partitions can be split, and the list of
their hashes is small by construction. Slot borders are literals in the plan:
a recomputed stage places every row in the same slot. Where no key passes the
limit the plan is the plain window, with no join.
"""

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window, functions as F

from tidegauge.session import materialize

DEFAULT_MAX_GROUP_ROWS = 20_000
SLOT = "_slot"


def max_group_rows(spark):
    return int(spark.conf.get("tidegauge.maxGroupRows", str(DEFAULT_MAX_GROUP_ROWS)))


@dataclass(frozen=True)
class SplitPlan:
    """Hashes of the split keys (None: every row) and the slot borders."""

    hashes: tuple | None
    borders: tuple

    @property
    def split(self):
        return bool(self.borders)


NO_SPLIT = SplitPlan((), ())


def _key_hash(keys):
    return F.xxhash64(*[F.col(k) for k in keys])


def plan_split(df, keys, by, limit=None):
    """Find keys too large for one task and borders that cut their rows evenly."""
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    limit = limit or max_group_rows(spark)
    slim = df.select(*keys, by.cast("double").alias("_by"))
    if keys:
        sizes = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        top = sizes.agg(F.max("_n").alias("top"), F.sum("_n").alias("total")).first()
        bound = max(limit, (top.total or 0) // parts)
        if (top.top or 0) <= bound:
            return NO_SPLIT
        hot = sizes.where(F.col("_n") > bound).select(_key_hash(keys).alias("h"))
        hashes = tuple(r.h for r in hot.collect())
        slim = slim.where(_key_hash(keys).isin(*hashes))
    else:
        if slim.count() <= limit:
            return NO_SPLIT
        hashes = None
    probs = [i / parts for i in range(1, parts)]
    cuts = slim.agg(F.percentile_approx("_by", probs, 10_000).alias("b")).first().b
    return SplitPlan(hashes, tuple(sorted(set(cuts or [0.0]))))


def with_slots(df, keys, by, plan):
    if not plan.split:
        return df.withColumn(SLOT, F.lit(0))
    cut = Bucketizer(
        splits=[float("-inf"), *plan.borders, float("inf")],
        inputCol="_by",
        outputCol="_bucket",
        handleInvalid="keep",
    )
    placed = cut.transform(df.withColumn("_by", by.cast("double")))
    slot = F.coalesce(F.col("_bucket").cast("int"), F.lit(-1))
    if plan.hashes is not None:
        slot = F.when(_key_hash(keys).isin(*plan.hashes), slot).otherwise(F.lit(0))
    return placed.withColumn(SLOT, slot).drop("_by", "_bucket")


def _columns(df, step, *args):
    built = {n: f(*args) for n, f in step.items()}
    return df.withColumns(built) if built else df


def scan(df, keys, order, by, local, summary, carry, combine, limit=None, plan=None):
    """Run an ordered scan per key.

    local    steps of ``{column: window -> Column}`` inside one slot
    summary  ``{column: aggregate}`` of one slot
    carry    steps of ``{column: window over earlier slots -> Column}``
    combine  ``{column: Column}`` from local and carried columns
    """
    plan = plan or plan_split(df, keys, by, limit)
    rows = with_slots(df, keys, by, plan)
    cells = [*keys, SLOT] if plan.split else list(keys)
    w = Window.partitionBy(*cells).orderBy(*order)
    for step in local:
        rows = _columns(rows, step, w)
    carried = [n for step in carry for n in step]
    if plan.split:
        slots = rows.groupBy(*keys, SLOT).agg(*[a.alias(n) for n, a in summary.items()])
        if plan.hashes is not None:
            slots = slots.where(_key_hash(keys).isin(*plan.hashes))
        earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(
            Window.unboundedPreceding, -1
        )
        for step in carry:
            slots = _columns(slots, step, earlier)
        slots = slots.select(*keys, SLOT, *carried)
        rows = rows.join(slots, [*keys, SLOT], "left")
    else:
        rows = rows.withColumns({n: F.lit(None) for n in carried}) if carried else rows
    rows = rows.withColumns(combine)
    scratch = [n for step in local for n in step] + carried + [SLOT]
    return rows.drop(*[n for n in scratch if n not in combine])


def _upto(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(df, keys, order, by, sums, limit=None, plan=None):
    """Inclusive running sums ``{out: Column}`` per key."""
    return scan(
        df, keys, order, by,
        local=[{f"_l_{o}": (lambda w, x=x: F.sum(x).over(_upto(w))) for o, x in sums.items()}],
        summary={f"_t_{o}": F.sum(x) for o, x in sums.items()},
        carry=[{f"_c_{o}": (lambda w, o=o: F.sum(f"_t_{o}").over(w)) for o in sums}],
        combine={
            o: F.coalesce(F.col(f"_c_{o}"), F.lit(0)) + F.coalesce(F.col(f"_l_{o}"), F.lit(0))
            for o in sums
        },
        limit=limit, plan=plan,
    )


def running_count(df, keys, order, by, out="rn", limit=None, plan=None):
    """Row number from 1 per key."""
    done = running_sum(df, keys, order, by, {out: F.lit(1).cast("bigint")}, limit, plan)
    return done.withColumn(out, F.col(out).cast("bigint"))


def previous(df, keys, order, by, cols, limit=None, plan=None):
    """Values of the row before, ``{out: Column}`` per key (NULL for the first).

    ``order`` holds column names, ascending.
    """
    plan = plan or plan_split(df, keys, by, limit)
    packed = F.struct(*[x.alias(o) for o, x in cols.items()])
    return scan(
        df, keys, order, by,
        local=[{"_lp": lambda w: F.lag(packed).over(w)}],
        summary={"_end": F.max_by(packed, F.struct(*order))},
        carry=[{"_cp": lambda w: F.last("_end").over(w)}],
        combine={
            o: F.when(F.col("_lp").isNotNull(), F.col("_lp")[o]).otherwise(F.col("_cp")[o])
            if plan.split
            else F.col("_lp")[o]
            for o in cols
        },
        plan=plan,
    )


def last_known(df, keys, order, by, cols, limit=None, plan=None):
    """Last non-NULL value at or before each row, ``{out: Column}`` per key."""
    tie = F.struct(*order)
    return scan(
        df, keys, order, by,
        local=[{f"_l_{o}": (lambda w, x=x: F.last(x, True).over(_upto(w))) for o, x in cols.items()}],
        summary={f"_e_{o}": F.max_by(x, F.when(x.isNotNull(), tie)) for o, x in cols.items()},
        carry=[{f"_c_{o}": (lambda w, o=o: F.last(f"_e_{o}", True).over(w)) for o in cols}],
        combine={o: F.coalesce(F.col(f"_l_{o}"), F.col(f"_c_{o}")) for o in cols},
        limit=limit, plan=plan,
    )


def resettable_cusum(df, keys, order, by, increment, out="cusum", limit=None, plan=None):
    """``S = max(0, S + x)`` per key, as prefix sum minus its running minimum.

    With C the prefix sum, ``S = C - min(0, min over the prefix of C)``; a slot
    needs only the total and the lowest prefix of the slots before it.
    """
    zero = F.lit(0.0)
    return scan(
        df, keys, order, by,
        local=[
            {"_c": lambda w: F.sum(increment).over(_upto(w))},
            {"_m": lambda w: F.min("_c").over(_upto(w))},
        ],
        summary={"_tot": F.sum(increment), "_low": F.min("_c")},
        carry=[
            {"_c0": lambda w: F.coalesce(F.sum("_tot").over(w), zero)},
            {"_m0": lambda w: F.min(F.col("_c0") + F.col("_low")).over(w)},
        ],
        combine={
            out: (F.coalesce(F.col("_c0"), zero) + F.col("_c"))
            - F.least(zero, F.col("_m0"), F.coalesce(F.col("_c0"), zero) + F.col("_m"))
        },
        limit=limit, plan=plan,
    )


def ranked_values(df, keys, value, limit=None, weight=None):
    """Distinct values per key: count ``_cnt``, count up to and with it ``_upto``, ``_total``.

    Copies of a value are counted map-side before the shuffle, so one hot value
    is one row. The counts are written once: the split plan, the ranks and the
    totals read them instead of running the input again. With ``weight`` the input
    is such a table of counts already.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, value)
    if weight:
        counted = rows.agg(F.sum(weight).alias("_cnt"))
    else:
        counted = materialize(rows.agg(F.count(F.lit(1)).alias("_cnt")))
    plan = plan_split(counted, keys, F.col(value), limit)
    ranked = running_sum(counted, keys, [value], F.col(value), {"_upto": F.col("_cnt")}, plan=plan)
    if not plan.split:
        return ranked.withColumn("_total", F.sum("_cnt").over(Window.partitionBy(*keys)))
    totals = counted.groupBy(*keys).agg(F.sum("_cnt").alias("_total"))
    return ranked.join(totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))


def pick_ranks(ranked, keys, value, ranks):
    """Order statistics: ``{out: 0-based rank Column of the total}`` per key."""
    picked = [
        F.min(F.when(F.col("_upto") > r(F.col("_total")), F.col(value))).alias(o)
        for o, r in ranks.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("_total").alias("_n"), *picked)


def exact_quantiles(df, keys, value, probs, limit=None, weight=None):
    """Exact linear-interpolation quantiles ``{out: q}`` per key.

    Same numbers as the built-in ``percentile``, without holding the distinct
    values of a key in one aggregation buffer.
    """
    ranks = {}
    for o, q in probs.items():
        ranks[f"_lo_{o}"] = lambda n, q=q: F.floor((n - 1) * F.lit(float(q)))
        ranks[f"_hi_{o}"] = lambda n, q=q: F.ceil((n - 1) * F.lit(float(q)))
    picked = pick_ranks(ranked_values(df, keys, value, limit, weight), keys, value, ranks)
    out = []
    for o, q in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{o}"), F.col(f"_hi_{o}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(o))
    return picked.select(*keys, *out)


def previous_known(df, keys, order, by, cols, limit=None, plan=None):
    """Last non-NULL value strictly before each row, ``{out: Column}`` per key."""
    tie = F.struct(*order)

    def before(w):
        return w.rowsBetween(Window.unboundedPreceding, -1)

    return scan(
        df, keys, order, by,
        local=[{f"_l_{o}": (lambda w, x=x: F.last(x, True).over(before(w))) for o, x in cols.items()}],
        summary={f"_e_{o}": F.max_by(x, F.when(x.isNotNull(), tie)) for o, x in cols.items()},
        carry=[{f"_c_{o}": (lambda w, o=o: F.last(f"_e_{o}", True).over(w)) for o in cols}],
        combine={o: F.coalesce(F.col(f"_l_{o}"), F.col(f"_c_{o}")) for o in cols},
        limit=limit, plan=plan,
    )


def following(df, keys, order, by, cols, limit=None, plan=None):
    """Values of the row after, ``{out: Column}`` per key (NULL for the last)."""
    plan = plan or plan_split(df, keys, by, limit)
    packed = F.struct(*[x.alias(o) for o, x in cols.items()])
    if not plan.split:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({o: F.lead(x).over(w) for o, x in cols.items()})
    rows = with_slots(df, keys, by, plan)
    w = Window.partitionBy(*keys, SLOT).orderBy(*order)
    rows = rows.withColumn("_ln", F.lead(packed).over(w))
    first = rows.groupBy(*keys, SLOT).agg(F.min_by(packed, F.struct(*order)).alias("_first"))
    later = Window.partitionBy(*keys).orderBy(SLOT)
    first = first.withColumn("_cn", F.lead("_first").over(later)).select(*keys, SLOT, "_cn")
    rows = rows.join(first, [*keys, SLOT], "left")
    picked = {
        o: F.when(F.col("_ln").isNotNull(), F.col("_ln")[o]).otherwise(F.col("_cn")[o])
        for o in cols
    }
    return rows.withColumns(picked).drop("_ln", "_cn", SLOT)
