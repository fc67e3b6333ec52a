"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Vectors are dealt to shards of bounded rows and bytes. A shard's different vectors become the nodes of a
graph; its rows' ids hang on their node, so thousands of equal vectors are one node and stay reachable. Nodes
are numbered from the highest layer down, so the layer of height h is the first ``k`` nodes, and its links are one
flat array of ``degree`` neighbours a node (-1: none). The graph is stored as a table, one row for each node
with its ids, vector and links, and can be searched by any later job.

Largest inner products become nearest neighbours of equal length: each vector gets one more component that
fills it up to the shard's greatest length, each query a zero. Graph walks use 32-bit floats, whole batches of walks
side by side in numpy; what they find is scored in double precision on the vectors as given.

Queries are dealt to blocks of bounded size; each (shard, block) pair is one task, with the shard's graph copied once a
block. Each task returns the best k rows of its shard, and ranks over all shards come from a window with a limit.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and rows without an id, take no
part; vectors of different length never meet; rows that share an id are not candidates of each other, and a query that stands
there twice with the same vector is one query; equal scores go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.bytewords import mix
from tidegauge.llm.shared import written

SHARD_ROWS = 1 << 14
SHARD_BYTES = 64 << 20
QUERY_ROWS = 1 << 13
DEGREE = 16
EF_BUILD, EF_SEARCH = 80, 256
BATCH, WIDE = 256, 4
NEIGHBOURS, EVERY = 20, 20


def layer_sizes(n: int, degree: int = DEGREE) -> list[int]:
    """Nodes of each layer from the lowest: each node rises with probability 1 / degree, drawn from its number."""
    draw = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
    heights = np.floor(-np.log(np.maximum(draw, 1e-300)) / np.log(degree)).astype(int)
    return [int((heights >= h).sum()) for h in range(int(heights.max()) + 1)] if n else []


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """The vectors, scaled to length 1 at most, with a component that fills each up to 1."""
    scaled = vectors / np.abs(vectors).max()
    scaled = scaled / np.sqrt((scaled**2).sum(axis=1).max())
    rest = np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))
    return np.concatenate((scaled, rest[:, None]), axis=1).astype(np.float32)


def walk(vectors, links, queries, entries, ef: int):
    """The ``ef`` most similar nodes that walks from the entries find: (nodes, similarities), best first, -1 where fewer."""
    n, count = len(links), len(queries)
    seen = np.zeros(count * n, dtype=bool)
    nodes = np.full((count, ef), -1, dtype=np.int64)
    close = np.full((count, ef), -np.inf, dtype=np.float32)
    fresh = np.zeros((count, ef), dtype=bool)
    nodes[:, 0], fresh[:, 0] = entries, True
    close[:, 0] = np.einsum("ij,ij->i", vectors[entries], queries)
    seen[np.arange(count) * n + entries] = True
    active = np.arange(count)
    while len(active):
        there = fresh[active]
        row, col = np.nonzero(there & (np.cumsum(there, axis=1) <= WIDE))
        row = active[row]
        fresh[row, col] = False
        near = links[nodes[row, col]]
        key = (row[:, None] * n + near)[near >= 0]
        key = np.unique(key[~seen[key]])
        seen[key] = True
        row, node = np.divmod(key, n)
        similar = np.einsum("ij,ij->i", vectors[node], queries[row])
        better = similar > close[row, -1]
        row, node, similar = row[better], node[better], similar[better]
        if len(row):
            who, first, sizes = np.unique(row, return_index=True, return_counts=True)
            at = np.repeat(np.arange(len(who)), sizes), np.arange(len(row)) - np.repeat(first, sizes)
            width = int(sizes.max())
            more_nodes = np.full((len(who), width), -1, dtype=np.int64)
            more_close = np.full((len(who), width), -np.inf, dtype=np.float32)
            more_nodes[at], more_close[at] = node, similar
            all_close = np.concatenate((close[who], more_close), axis=1)
            order = np.argsort(-all_close, axis=1, kind="stable")[:, :ef]
            close[who] = np.take_along_axis(all_close, order, axis=1)
            nodes[who] = np.take_along_axis(np.concatenate((nodes[who], more_nodes), axis=1), order, axis=1)
            fresh[who] = np.take_along_axis(np.concatenate((fresh[who], more_nodes >= 0), axis=1), order, axis=1)
        active = active[fresh[active].any(axis=1)]
    return nodes, close


def spread(vectors, found, close, m: int) -> np.ndarray:
    """Of each row's found nodes, best first, ``m`` that are closer to it than to one another; then the best of the rest."""
    held = vectors[np.maximum(found, 0)]
    cross = held @ held.transpose(0, 2, 1)
    keep, count = np.zeros(found.shape, dtype=bool), np.zeros(len(found), dtype=int)
    for j in range(found.shape[1]):
        keep[:, j] = (found[:, j] >= 0) & (count < m) & ~((cross[:, j] >= close[:, j, None]) & keep).any(axis=1)
        count += keep[:, j]
    rank = np.arange(found.shape[1]) + found.shape[1] * (~keep) + 2 * found.shape[1] * (found < 0)
    best = np.argsort(rank, axis=1, kind="stable")[:, :m]
    chosen = np.take_along_axis(found, best, axis=1)
    return np.pad(chosen, ((0, 0), (0, m - chosen.shape[1])), constant_values=-1)


def ordered(found, close):
    """Each row best first, without repeats of a node."""
    order = np.argsort(found, axis=1, kind="stable")
    found, close = np.take_along_axis(found, order, axis=1), np.take_along_axis(close, order, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    close = np.where(found < 0, -np.inf, close)
    order = np.argsort(-close, axis=1, kind="stable")
    return np.take_along_axis(found, order, axis=1), np.take_along_axis(close, order, axis=1)


def _link_back(vectors, links, sources, chosen) -> None:
    """Add each source to its chosen nodes' links; a node with too many keeps a spread of them."""
    if (chosen < 0).all():
        return
    source = np.repeat(sources, chosen.shape[1])[chosen.ravel() >= 0]
    node = chosen.ravel()[chosen.ravel() >= 0]
    similar = np.einsum("ij,ij->i", vectors[node], vectors[source])
    order = np.lexsort((-similar, node))
    source, node = source[order], node[order]
    who, first, sizes = np.unique(node, return_index=True, return_counts=True)
    # Of very many new links only the closest few can stay.
    place = np.arange(len(node)) - np.repeat(first, sizes)
    close = place < 2 * links.shape[1]
    more = np.full((len(who), min(int(sizes.max()), 2 * links.shape[1])), -1, dtype=np.int64)
    more[np.repeat(np.arange(len(who)), sizes)[close], place[close]] = source[close]
    for low in range(0, len(who), BATCH):
        part = who[low : low + BATCH]
        held = np.concatenate((links[part], more[low : low + BATCH]), axis=1)
        similar = np.where(held < 0, -np.inf, np.einsum("ij,ikj->ik", vectors[part], vectors[np.maximum(held, 0)]))
        links[part] = spread(vectors, *ordered(held, similar), links.shape[1])


def built(vectors: np.ndarray, degree: int = DEGREE, ef: int = EF_BUILD) -> list[np.ndarray]:
    """Links of each layer from the lowest, for vectors of length 1; upper layers are whole before a lower one begins."""
    sizes, layers = layer_sizes(len(vectors), degree), []
    for height, size in reversed(list(enumerate(sizes))):
        links = np.full((size, degree if height else 2 * degree), -1, dtype=np.int64)
        done = 0
        while done < size:
            now = np.arange(done, min(size, done + min(BATCH, max(done, 64))))
            queries = vectors[now]
            # Nodes of a batch meet each other directly, all earlier ones by walks.
            among = queries @ queries.T
            np.fill_diagonal(among, -np.inf)
            best = np.argsort(-among, axis=1, kind="stable")[:, : 2 * degree]
            found, close = now[best], np.take_along_axis(among, best, axis=1)
            found = np.where(np.isfinite(close), found, -1)
            if done:
                entries = _descend(vectors, layers, queries)
                entries = np.where(entries < done, entries, 0)
                walked, similar = walk(vectors, links[:done], queries, entries, ef)
                found, close = np.concatenate((walked, found), axis=1), np.concatenate((similar, close), axis=1)
            links[now, :degree] = chosen = spread(vectors, *ordered(found, close), degree)
            _link_back(vectors, links, now, chosen)
            done = int(now[-1]) + 1
        layers.insert(0, links)
    return layers


def _descend(vectors, layers, queries) -> np.ndarray:
    """Where walks of the layer below the given ones begin."""
    entries = np.zeros(len(queries), dtype=np.int64)
    for links in reversed(layers):
        entries = walk(vectors, links, queries, entries, WIDE)[0][:, 0]
    return entries


def searched(vectors, layers, queries, ef: int = EF_SEARCH) -> np.ndarray:
    """Nodes near each query, -1 where fewer than ``ef`` are reached."""
    return walk(vectors, layers[0], queries, _descend(vectors, layers[1:], queries), ef)[0]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _by_length(values: dict[int, int]) -> Column:
    """The value of each length of vectors, 0 for others."""
    if not values:
        return F.lit(0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("dim")), F.lit(0))


def _flat(column: pa.ChunkedArray, kind) -> np.ndarray:
    whole = column.combine_chunks()
    return np.asarray(whole.flatten().to_numpy(zero_copy_only=False), dtype=kind)


_NODES = "dim int, shard int, node int, ids array<long>, vector array<double>, links array<int>, upper array<int>"


def build_index(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each node of each shard's graph; ``upper`` holds its links of the layers above the lowest, one after the other."""
    values = rows.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    # One row for each length of vectors.
    counts = {r.dim: r.n for r in values.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    shards = {dim: -(-n // max(1, min(shard_rows, shard_bytes // (8 * dim)))) for dim, n in counts.items()}
    dealt = values.select("*", F.size("vector").alias("dim"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), _by_length(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        ids = table.column("id").to_numpy()
        vectors = _flat(table.column("vector"), np.float64).reshape(-1, dim) + 0.0
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(axis=1)))
        heads = np.flatnonzero(new)
        # Nodes in an order that does not follow their values.
        shuffled = np.argsort(mix(np.arange(len(heads), dtype=np.uint64)), kind="stable")
        cuts = np.append(heads, len(ids))
        vectors = vectors[heads[shuffled]]
        layers = built(lengthened(vectors))
        upper = [np.concatenate([x[i] for x in layers[1:] if i < len(x)]) if len(layers) > 1 and i < len(layers[1]) else np.zeros(0, np.int64) for i in range(len(heads))]
        return pa.table({
            "dim": pa.array(np.full(len(heads), dim, np.int32)), "shard": pa.array(np.full(len(heads), shard, np.int32)), "node": pa.array(np.arange(len(heads), dtype=np.int32)),
            "ids": pa.array([ids[cuts[h] : cuts[h + 1]] for h in shuffled], pa.list_(pa.int64())), "vector": pa.array(list(vectors), pa.list_(pa.float64())),
            "links": pa.array(list(layers[0]), pa.list_(pa.int32())), "upper": pa.array(upper, pa.list_(pa.int32())),
        })

    return dealt.groupBy("dim", "shard").applyInArrow(build, _NODES)


def _layers(links: np.ndarray, upper: list[np.ndarray], degree: int = DEGREE) -> list[np.ndarray]:
    layers, height = [links], 0
    while True:
        held = [u[height * degree : (height + 1) * degree] for u in upper if len(u) > height * degree]
        if not held:
            return layers
        layers.append(np.stack(held).astype(np.int64))
        height += 1


def search_index(index: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = NEIGHBOURS, ef: int = EF_SEARCH, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest found among rows of another id."""
    asked = queries.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q")).distinct()
    blocks = max(1, -(-asked.count() // query_rows))
    dealt = asked.select("*", F.size("q").alias("dim"), F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)).cast("int").alias("block"))
    # Every block of queries meets every shard of its length of vectors.
    shards = {r.dim: r.n for r in index.groupBy("dim").agg(F.max("shard").alias("n")).collect()}
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), _by_length(shards))))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    nothing = pa.table({"query_id": pa.array([], pa.int64()), "q_hash": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def search(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        if not nodes.num_rows or not asked.num_rows:
            return nothing
        nodes = nodes.sort_by("node")
        dim = nodes.column("dim")[0].as_py()
        values = _flat(nodes.column("vector"), np.float64).reshape(-1, dim)
        links = _flat(nodes.column("links"), np.int64).reshape(len(values), -1)
        sizes = np.diff(nodes.column("upper").combine_chunks().offsets.to_numpy())
        upper = np.split(_flat(nodes.column("upper"), np.int64), np.cumsum(sizes)[:-1])
        ids, owners = _flat(nodes.column("ids"), np.int64), nodes.column("ids").combine_chunks().value_lengths().to_numpy()
        begins = np.cumsum(owners) - owners
        vectors, layers = lengthened(values), _layers(links, upper)
        names, hashes = asked.column("query_id").to_numpy(), asked.column("q_hash").to_numpy()
        wanted = _flat(asked.column("q"), np.float64).reshape(-1, dim)
        parts = []
        for low in range(0, len(names), BATCH):
            q = wanted[low : low + BATCH]
            unit = q / np.abs(q).max(axis=1)[:, None]
            unit = np.pad(unit / np.sqrt((unit**2).sum(axis=1))[:, None], ((0, 0), (0, 1))).astype(np.float32)
            found = searched(vectors, layers, unit, ef)
            row, col = np.nonzero(found >= 0)
            node = found[row, col]
            score = np.einsum("ij,ij->i", values[node], q[row])
            # The smallest ids of a node come first, and one of them may be the query's own.
            many = np.minimum(owners[node], k + 1)
            row, score = np.repeat(row, many), np.repeat(score, many)
            one = ids[np.repeat(begins[node], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            other = one != names[low : low + BATCH][row]
            row, score, one = row[other], score[other], one[other]
            order = np.lexsort((one, -score, row))
            row, score, one = row[order], score[order], one[order]
            first = np.searchsorted(row, row)
            best = np.arange(len(row)) - first < k
            parts.append((names[low + row[best]], hashes[low + row[best]], one[best], score[best]))
        return pa.table({n: pa.array(np.concatenate([p[i] for p in parts])) for i, n in enumerate(nothing.column_names)})

    dealt = dealt.withColumn("q_hash", F.xxhash64("q"))
    found = copies.groupBy("dim", "shard", "block").cogroup(dealt.groupBy("dim", "shard", "block")).applyInArrow(search, "query_id long, q_hash long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_hash").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(rows: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, **options) -> DataFrame:
    """The nearest rows of every row whose vec_id is divisible by ``every``."""
    index = written(build_index(rows.select("vec_id", "embedding"), **options))
    return search_index(index, rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding"), k=k)
