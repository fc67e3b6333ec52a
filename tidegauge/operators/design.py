"""Experiment design checks: splits, balance, lineage, reconciliation, leaks."""

import json
from functools import reduce

from pyspark.sql import functions as F

from tidegauge.operators import skew


def overlaps(roles, key="id"):
    """Ids that carry more than one role. Roles per id combine map-side."""
    return roles.select(key, "role").distinct().groupBy(key).agg(
        F.array_sort(F.collect_list("role")).alias("roles")
    ).where(F.size("roles") > 1)


def factorial_balance(rows, factors, expected):
    """Every cell of the level cross product against its expected count."""
    levels = [rows.select(f).distinct() for f in factors]
    cells = reduce(lambda a, b: a.crossJoin(b), levels)
    found = rows.groupBy(*factors).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(found, list(factors), "left").select(
        *factors, F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) == expected).alias("balanced"),
    )


def role_conflicts(records):
    """Campaigns, stacks and raw fingerprints that hold more than one role.

    A derived record counts under its source campaign.
    """
    base = records.withColumn("_campaign", F.coalesce("source_campaign", "campaign"))
    kinds = F.array(
        F.struct(F.lit("campaign").alias("kind"), F.col("_campaign").cast("string").alias("id")),
        F.struct(F.lit("stack").alias("kind"), F.col("stack").cast("string").alias("id")),
    )
    prints = F.transform(
        "fingerprints", lambda x: F.struct(F.lit("fingerprint").alias("kind"), x.cast("string").alias("id"))
    )
    rows = base.select("role", F.explode(F.concat(kinds, prints)).alias("k")).select("role", "k.*")
    return rows.distinct().groupBy("kind", "id").agg(F.count(F.lit(1)).alias("roles")).where("roles > 1")


def derangement(rows, strata, key, step="i"):
    """Donor row from the next key of the same stratum and step; singletons have none.

    The rank is taken over distinct keys of a stratum, not over rows.
    """
    members = rows.select(*strata, key).distinct()
    ranked = skew.running_count(members, list(strata), [key], F.col(key), "_rn")
    sizes = members.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(sizes, list(strata))
    donor = ranked.select(*strata, F.col(key).alias("donor"), F.col("_rn").alias("_at"))
    return ranked.withColumn("_at", F.col("_rn") % F.col("_n") + 1).join(
        donor, [*strata, "_at"]
    ).select(*strata, key, F.when(F.col("donor") != F.col(key), F.col("donor")).alias("donor"))


def reconcile(expected, observed, keys, fields):
    """Full outer comparison with the first mismatch named."""
    e = expected.select(*keys, F.struct(*fields).alias("_e"))
    o = observed.select(*keys, F.struct(*fields).alias("_o"))
    both = e.join(o, list(keys), "full_outer")
    reason = F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
    for f in fields:
        reason = reason.when(~F.col("_e")[f].eqNullSafe(F.col("_o")[f]), f)
    return both.select(*keys, reason.alias("mismatch"))


def wave_barrier(cases):
    """Per batch: both waves exist, and the first ends before the second starts."""
    end = F.max(F.when(F.col("wave") == 0, F.col("stop")))
    start = F.min(F.when(F.col("wave") == 1, F.col("start")))
    return cases.groupBy("batch").agg(
        F.coalesce(end <= start, F.lit(False)).alias("barrier"),
        F.bool_and(F.col("start") < F.col("stop")).alias("ordered"),
    )


def lane_isolation(cases):
    return cases.select("lane", "project").distinct().groupBy("lane").agg(
        F.count(F.lit(1)).alias("projects")
    ).withColumn("isolated", F.col("projects") == 1)


def parity(left, right, keys, values, flags=()):
    """Largest difference per value column, differing flags, and rows of one side only."""
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in (*values, *flags)], F.lit(1).alias("_a"))
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in (*values, *flags)], F.lit(1).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
        *[F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(f"max_{c}_difference") for c in values],
        *[F.count_if(F.col(f"a_{c}") != F.col(f"b_{c}")).alias(f"{c}_changes") for c in flags],
    )


# JSON text cannot hold these characters bare, so they stand for an escaped
# backslash and an escaped quote; every string is then free of inner quotes.
ESCAPED = [("\\\\\\\\", "\x02"), ("\\\\\"", "\x01")]


def _plain(text):
    for pattern, mark in ESCAPED:
        text = F.regexp_replace(text, pattern, mark)
    return text


def leaf_texts(json_column):
    """Every key and every string value of a JSON text, at any depth."""
    parts = F.regexp_extract_all(_plain(json_column), F.lit(r'"[^"]*"\s*:?'), F.lit(0))
    is_key = lambda x: x.endswith(":")
    bare = lambda x: F.substring_index(F.substring_index(x, '"', 2), '"', -1)
    return (
        F.transform(F.filter(parts, is_key), bare),
        F.transform(F.filter(parts, lambda x: ~is_key(x)), bare),
    )


def _encoded(value):
    return json.dumps(value, ensure_ascii=False)[1:-1].replace("\\\\", "\x02").replace('\\"', "\x01")


def leaks(rows, json_column, forbidden_keys, forbidden_values):
    """Rows whose payload has a forbidden key part or a forbidden value at any depth."""
    keys, values = leaf_texts(F.col(json_column))
    key_hit = F.exists(
        keys, lambda k: reduce(lambda a, b: a | b, [F.lower(k).contains(f) for f in forbidden_keys])
    )
    value_hit = F.arrays_overlap(values, F.array(*[F.lit(_encoded(v)) for v in forbidden_values]))
    return rows.where(key_hit | value_hit)
