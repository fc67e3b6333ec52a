"""Exact cosine neighbours, class margins, abstention and retrieval metrics."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
#: Most rows, about, of one side in a task.
BLOCK_ROWS = 32_768
#: Queries and bank rows of one product inside a task; byte counts of 8 lanes hold 255 words of 8 columns.
TILE_ROWS, TILE_COLUMNS = 512, 2_040
#: Bank rows whose largest product bounds the k-th best from below.
GROUP = 64


def unit(vector):
    """L2-normalised array; a zero vector becomes NULL."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm))


NEIGHBOUR_SCHEMA = "query_id bigint, bank_id bigint, bank_label int, sim double"


def _vectors(table, name):
    """Rows of an Arrow list column as a matrix; a missing vector or mixed lengths are refused."""
    column = table[name].combine_chunks()
    widths = np.diff(column.offsets.to_numpy())
    if column.null_count or widths.min() != widths.max():
        raise ValueError(f"{column.null_count} vectors are missing, the others have {widths.min()} to {widths.max()} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ids(table, name):
    return table[name].to_numpy().astype(np.int64)


def _labels(table, name):
    """Labels and whether they are there."""
    column = table[name].combine_chunks()
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def _short(q, b):
    """Both sides in single precision, and how far their products can be from the exact ones."""
    reach = np.sqrt((q**2).sum(axis=1).max(initial=0.0) * (b**2).sum(axis=1).max(initial=0.0))
    return q.astype(np.float32), b.astype(np.float32), np.float32((q.shape[1] + 4) * 2.0**-22 * reach)


def _exact(q, b, r, c):
    """Products of the given pairs in double precision, each summed in the same order wherever it stands."""
    out = np.empty(len(r))
    for i in range(0, len(r), 65_536):
        part = slice(i, i + 65_536)
        out[part] = (q[r[part]] * b[c[part]]).sum(axis=1)
    return out


def _same(left, ids, order):
    """Index pairs of equal ids; ``order`` sorts ``ids``."""
    at = ids[order]
    low, n = np.searchsorted(at, left), np.searchsorted(at, left, "right") - np.searchsorted(at, left)
    r = np.repeat(np.arange(len(left)), n)
    return r, order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(r))]


def _places(mask):
    """Row and column of the true cells."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1]) if mask.size else (np.zeros(0, np.int64),) * 2


def _counts(mask):
    """True cells per row; eight columns are added at a time."""
    rows, n = mask.shape
    if n % 8 or n > 8 * 255:
        return mask.sum(axis=1)
    return mask.view(np.uint64).sum(axis=1).view(np.uint8).reshape(rows, 8).sum(axis=1, dtype=np.int64)


def _first(*keys):
    """Whether a row differs from the one before in any of the sorted keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return new


def _rank(new):
    """Place, from 0, of each row after the last start."""
    n = np.arange(len(new))
    return n - np.maximum.accumulate(np.where(new, n, 0))


def _block_candidates(q_ids, q, b_ids, b_labels, b, k):
    """Row, column and product per query: the k best of a bank block, and the best of its two best labels.

    Enough to find the global top k and the best row of another class: in the block that holds it, it is the best
    of the best label or of the next. Products are taken in single precision; all that can be among these by its
    error are computed again in double.
    """
    # Equal labels stand together.
    by = np.argsort(b_labels, kind="stable")
    b_ids, b_labels, b = b_ids[by], b_labels[by], b[by]
    starts = np.flatnonzero(_first(b_labels))
    ends = np.append(starts[1:], len(b))
    order = np.argsort(b_ids, kind="stable")
    q32, b32, error = _short(q, b)
    found = []
    step = max(1, TILE_ROWS * TILE_COLUMNS * 4 // len(b))
    for i in range(0, len(q), step):
        sims = q32[i : i + step] @ b32.T
        sims[_same(q_ids[i : i + step], b_ids, order)] = -np.inf
        tops = np.maximum.reduceat(sims, starts, axis=1)
        second = np.partition(tops, -2, axis=1)[:, -2] if len(starts) > 1 else tops[:, 0]
        hits = []
        for label, (low, high) in enumerate(zip(starts, ends)):
            rows = np.flatnonzero(tops[:, label] >= second - 2 * error)
            r, c = _places(sims[rows, low:high] >= (tops[rows, label] - 2 * error)[:, None])
            hits.append(rows[r] * len(b) + c + low)
        if k > 1:
            whole = len(b) // GROUP * GROUP
            peaks = sims[:, :whole].reshape(len(sims), -1, GROUP).max(axis=2)
            floor = np.partition(peaks, -k, axis=1)[:, -k] if peaks.shape[1] >= k else np.full(len(sims), -np.inf, np.float32)
            r, c = _places(sims >= (floor - 2 * error)[:, None])
            hits.append(r * len(b) + c)
        r, c = np.divmod(np.unique(np.concatenate(hits)), len(b))
        there = sims[r, c] > -np.inf
        r, c = r[there] + i, c[there]
        sim = _exact(q, b, r, c)
        # The best of each label, then the first two of them; and the first k of all.
        at = np.lexsort((b_ids[c], -sim, b_labels[c], r))
        best = at[_first(r[at], b_labels[c[at]])]
        best = best[np.lexsort((b_ids[c[best]], -sim[best], r[best]))]
        best = best[_rank(_first(r[best])) < 2]
        at = np.lexsort((b_ids[c], -sim, r))
        keep = np.union1d(best, at[_rank(_first(r[at])) < k])
        found.append((r[keep], by[c[keep]], sim[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def candidates(queries, bank, k):
    """Per query the rows of the bank that can matter: ``query_id, bank_id, bank_label, sim``.

    Inputs: ``id, vector`` (unit) and ``id, label, vector``.
    """
    def probe(left, right):
        q, b = _vectors(left, "vector"), _vectors(right, "bank_vector")
        rows, cols = (np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (q, b))
        labels, known = _labels(right, "bank_label")
        # A missing label is one more class.
        classes = np.where(known, labels.astype(np.int64), np.iinfo(np.int64).min)
        q_ids, b_ids = _ids(left, "id"), _ids(right, "bank_id")
        if not len(rows) or not len(cols):
            return None
        r, c, sim = _block_candidates(q_ids[rows], q[rows], b_ids[cols], classes[cols], b[cols], k)
        c = cols[c]
        return [q_ids[rows[r]], b_ids[c], pa.array(labels[c], mask=~known[c]), sim]

    known = "id IS NOT NULL"
    return _over_bank(queries.select("id", "vector").where(known), bank.where(known), probe, NEIGHBOUR_SCHEMA)


def first_relevant_rank(queries, bank):
    """Rank of the best bank row that carries the query's own label (NULL: none).

    Two passes over the bank: the best row of the label, for which equal labels meet, then a count of the rows
    that come before it. ``queries``: ``id, label, vector``.
    """
    def best(left, right):
        q, b = _vectors(left, "vector"), _vectors(right, "bank_vector")
        q_ids, b_ids = _ids(left, "id"), _ids(right, "bank_id")
        (q_labels, asked), (b_labels, known) = _labels(left, "label"), _labels(right, "bank_label")
        asked, known = asked & np.isfinite(q).all(axis=1), known & np.isfinite(b).all(axis=1)
        out = []
        for label in np.intersect1d(q_labels[asked], b_labels[known]):
            rows, cols = np.flatnonzero(asked & (q_labels == label)), np.flatnonzero(known & (b_labels == label))
            r, c, sim = _block_candidates(q_ids[rows], q[rows], b_ids[cols], b_labels[cols], b[cols], 1)
            out.append((q_ids[rows[r]], sim, b_ids[cols[c]]))
        return [np.concatenate(x) for x in zip(*out)] or None

    def before(left, right):
        q, b = _vectors(left, "vector"), _vectors(right, "bank_vector")
        b_ids, q_ids, at = _ids(right, "bank_id"), _ids(left, "id"), _ids(left, "best_id")
        cols = np.flatnonzero(np.isfinite(b).all(axis=1))
        b, b_ids = b[cols], b_ids[cols]
        line = left["best_sim"].to_numpy()
        q32, b32, error = _short(q, b)
        low, high = (line - 2 * error).astype(np.float32), (line + 2 * error).astype(np.float32)
        ahead = np.zeros(len(q), dtype=np.int64)
        for j in range(0, len(b), TILE_COLUMNS):
            part = b32[j : j + TILE_COLUMNS].T
            ids = b_ids[j : j + TILE_COLUMNS]
            order = np.argsort(ids, kind="stable")
            for i in range(0, len(q), TILE_ROWS):
                some = slice(i, i + TILE_ROWS)
                sims = q32[some] @ part
                sims[_same(q_ids[some], ids, order)] = -np.inf
                sims[_same(at[some], ids, order)] = -np.inf
                over, near = _counts(sims > high[some, None]), _counts(sims >= low[some, None])
                ahead[some] += over
                # Those too near to tell are computed again.
                rows = np.flatnonzero(over != near)
                r, c = _places((sims[rows] >= low[i + rows, None]) & (sims[rows] <= high[i + rows, None]))
                r = i + rows[r]
                sim = _exact(q, b, r, c + j)
                before = (sim > line[r]) | ((sim == line[r]) & (ids[c] < at[r]))
                ahead += np.bincount(r[before], minlength=len(q))
        return [q_ids, ahead]

    known = "id IS NOT NULL"
    asked, bank = queries.where(known), bank.where(known)
    found = _over_bank(
        asked.select("id", "label", "vector"), bank, best,
        "id bigint, best_sim double, best_id bigint",
    )
    top = found.groupBy("id").agg(
        F.max(F.struct("best_sim", (-F.col("best_id")).alias("n"))).alias("t")
    ).select("id", F.col("t.best_sim").alias("best_sim"), (-F.col("t.n")).alias("best_id"))
    counted = _over_bank(
        asked.select("id", "vector").join(top, "id"), bank, before, "id bigint, ahead bigint", queries.count()
    )
    ranks = counted.groupBy("id").agg((F.sum("ahead") + 1).alias("first_rank"))
    return queries.select("id", "label").join(ranks, "id", "left")


def _over_bank(queries, bank, probe, schema, rows=None):
    """Run ``probe(queries, bank rows)`` on Arrow tables so that every query meets every bank row.

    Both sides are cut into strips, as many as the root of the shuffle partitions or more if they would be long.
    Each (query strip, bank strip) pair is one task of bounded size that returns columns with a bounded part per
    query, so a row is copied once per strip of the other side. ``rows``: number of queries at most, if known.
    """
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strips = lambda n: max(1, math.isqrt(parts - 1) + 1, -(-n // BLOCK_ROWS))
    nq, nb = strips(queries.count() if rows is None else rows), strips(bank.count())
    spread = lambda n: F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    )
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n).cast("bigint"))
    q = queries.withColumn("qb", block(nq)).withColumn("bb", spread(nb))
    b = bank.select(
        block(nb).alias("bank_block"), spread(nq).alias("query_block"), F.col("id").alias("bank_id"),
        F.col("label").alias("bank_label"), F.col("vector").alias("bank_vector"),
    )
    fields = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, schema.split(","))])

    def meet(left, right):
        out = probe(left, right) if left.num_rows and right.num_rows else None
        return fields.empty_table() if out is None else pa.table([pa.array(x).cast(f.type) for x, f in zip(out, fields)], schema=fields)

    # As many partitions as pairs of strips, so that small ones are not put together again.
    n = min(nq * nb, 10 * parts)
    return q.repartition(n, "qb", "bb").groupBy("qb", "bb").cogroup(
        b.repartition(n, "query_block", "bank_block").groupBy("query_block", "bank_block")
    ).applyInArrow(meet, schema)


def rank_candidates(found):
    """Rank per query by (similarity, id); a query has few candidates."""
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "bank_id")
    return found.withColumn("rank", F.row_number().over(w))


def class_margin(found):
    """Top similarity minus the best of another class, per query.

    The best row of each class comes first, so a query's window holds one row per
    class.
    """
    best = found.groupBy("query_id", "bank_label").agg(
        F.max(F.struct("sim", (-F.col("bank_id")).alias("n"))).alias("b")
    )
    w = Window.partitionBy("query_id").orderBy(F.col("b").desc())
    rows = best.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead("b.sim").over(w))
    return rows.where("_rn = 1").select(
        "query_id", F.col("bank_label").alias("top_label"), F.col("b.sim").alias("top_sim"),
        F.coalesce(F.col("b.sim") - F.col("_next"), F.lit(0.0)).alias("margin"),
    )


def retrieval_metrics(first_rank, label, k=3):
    """hit@1, hit@k and mean reciprocal rank, overall and per class."""
    r = F.col("first_rank")
    return first_rank.groupingSets([[], [label]], F.col(label)).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.coalesce(r == 1, F.lit(False)).cast("int")).alias("hit1"),
        F.avg(F.coalesce(r <= k, F.lit(False)).cast("int")).alias("hit_k"),
        F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"),
    )
