"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beams.

1. Equal vectors are one node; a node keeps its k + 1 least ids, which is all that a k-nearest answer can use. Nodes are dealt by hash to
   shards of about `shard_nodes`, so a vector that a third of the rows share is one node of one shard.
2. A task builds its shard's graph: nodes enter in growing batches, greedy searches on the graph so far propose neighbours, robust pruning
   keeps a candidate only if no kept one is `alpha` times closer to it than the new node is, and kept edges are also offered in the
   opposite direction, where full lists are pruned again. A shard is one row of packed arrays in the shared folder.
3. Queries are packed into blocks of about `block_queries`; every block meets every shard and all its queries run down the graph together as
   beams. Distances are double precision; vectors are first multiplied by a power of two that keeps squares in range, which rounds nothing.
4. Per query the best of all shards are merged, nodes are replaced by their ids, and ranked.

Searches take part only within vectors of their own length. Rows with a null id, and vectors that are null, empty, zero or hold null or
non-finite components, take no part; repeated rows count once; ties go to the smaller id; fewer candidates than k are all returned.
An id with several different vectors is so many rows: as a query each has its own list (same query_id, told apart by query_hash), and
the others of the id are candidates. Vectors over 2^256 times smaller than others are dealt to shards of their own.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from nearmiss.session import durable

DEGREE, BUILD_BEAM, ALPHA = 32, 64, 1.2
_FAR = np.inf
#: Vectors of one shard differ by less than 2 to this power; search scales are multiples of a quarter of it.
BAND = 256


def _distances(x, points, candidates):
    """Squared distances of each row of points to its candidates (ids, -1 reads as infinitely far)."""
    gap = x[np.maximum(candidates, 0)] - points[:, None, :]
    out = np.einsum("qcd,qcd->qc", gap, gap)
    out[candidates < 0] = _FAR
    return out


def beam_search(x, graph, entry, points, beam: int, step: int = 4):
    """(ids, squared distances), nearest first, of the beam of each point after greedy search from the entry; -1 where it is not full."""
    n = len(points)
    ids = np.full((n, beam), -1, np.int64)
    ids[:, 0] = entry
    far = np.full((n, beam), _FAR)
    far[:, :1] = _distances(x, points, ids[:, :1])
    done = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column takes what is no node
    seen[:, [entry, -1]] = True
    active = np.arange(n)
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), _FAR, far[active])
        at = np.argsort(open_, axis=1, kind="stable")[:, :step]
        live = np.take_along_axis(open_, at, 1) < _FAR
        some = live[:, 0]
        active, at, live = active[some], at[some], live[some]
        if not len(active):
            break
        a = active[:, None]
        done[a, at] |= live
        near = graph[np.where(live, ids[a, at], len(x))].reshape(len(active), -1)
        near = np.where(seen[a, near], -1, near)
        order = np.sort(near, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        seen[a, order] = True
        found = _distances(x, points[active], order)
        every, dist = np.concatenate([ids[active], order], 1), np.concatenate([far[active], found], 1)
        flags = np.concatenate([done[active], np.zeros_like(order, bool)], 1)
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids[active], far[active], done[active] = (np.take_along_axis(v, best, 1) for v in (every, dist, flags))
    return np.where(far < _FAR, ids, -1), far


def robust_prune(x, nodes, candidates, degree: int = DEGREE, alpha: float = ALPHA):
    """Neighbour lists [nodes, degree] (-1 where empty): nearest first, dropping candidates that a kept one is alpha times closer to."""
    far = _distances(x, x[nodes], candidates)
    far[candidates == nodes[:, None]] = _FAR
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    vectors = x[np.maximum(candidates, 0)] - x[nodes][:, None, :]  # seen from the node, so a common offset costs no digits
    norm = np.einsum("ncd,ncd->nc", vectors, vectors)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive, out, rows = far < _FAR, np.full((len(nodes), degree), -1, np.int64), np.arange(len(nodes))
    repeated = (candidates[:, :, None] == candidates[:, None, :]) & (np.arange(candidates.shape[1])[:, None] > np.arange(candidates.shape[1])[None, :])
    alive &= ~repeated.any(2)
    for r in range(degree):
        pick = alive.argmax(1)
        ok = alive[rows, pick]
        if not ok.any():
            break
        out[ok, r] = candidates[rows, pick][ok]
        alive &= ~(ok[:, None] & (alpha * alpha * between[rows, pick] <= far))
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3):
    """(graph [n + 1, degree], entry): the last row has no edges; empty places hold n."""
    n = len(x)
    graph = np.full((n + 1, degree), n, np.int64)
    centre = x.mean(0)
    entry = int(np.argmin(((x - centre) ** 2).sum(1)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        new = order[done:done + min(256, max(8, done // 2))]
        found, _ = beam_search(x, graph, entry, x[new], beam)
        if done == 1:  # the first batch also proposes its own members
            found = np.concatenate([found, np.tile(new, (len(new), 1))], 1)
        kept = robust_prune(x, new, found, degree, alpha)
        graph[new] = np.where(kept < 0, n, kept)
        source, target = np.repeat(new, degree), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        nodes, counts = target[heads], np.diff(np.append(heads, len(target)))
        offered = np.full((len(nodes), int(counts.max()) if len(counts) else 0), -1, np.int64)
        offered[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(heads, counts)] = source
        have = np.where(graph[nodes] == n, -1, graph[nodes])
        for low in range(0, len(nodes), 256):
            part = slice(low, low + 256)
            merged = np.concatenate([have[part], offered[part]], 1)
            room = (merged >= 0).sum(1) <= degree
            packed = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)
            if packed.shape[1] < degree:
                packed = np.concatenate([packed, np.full((len(packed), degree - packed.shape[1]), -1)], 1)
            lists = packed[:, :degree].copy()
            if not room.all():
                width = int((merged[~room] >= 0).sum(1).max())
                lists[~room] = robust_prune(x, nodes[part][~room], packed[~room][:, :width], degree, alpha)
            graph[nodes[part]] = np.where(lists < 0, n, lists)
        done += len(new)
    return graph, entry


def usable(vector):
    """Column: the vector may take part."""
    x = F.col(vector)
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def scale(x) -> int:
    """A power of two that brings the largest component to at most 1, in coarse steps."""
    step = BAND // 4
    return -int(-(-int(np.frexp(np.abs(x).max())[1]) // step) * step)


_SHARD = "dim int, band int, shard long, nodes binary, vectors binary, graph binary, entry int"


def build_index(vectors: DataFrame, shard_nodes: int = 4096):
    """vectors: node long, variant long, embedding. One row per shard with its nodes, vectors and graph."""
    shards = max(1, -(-vectors.count() // shard_nodes))

    def build(pdf):
        x = np.stack(pdf["embedding"].to_list()).astype(np.float64)
        graph, entry = build_graph(np.ldexp(x, scale(x)))
        return pd.DataFrame([[*(int(pdf[c].iloc[0]) for c in ("dim", "band", "shard")), pdf[["node", "variant"]].to_numpy().astype("<i8").tobytes(),
                              x.astype("<f8").tobytes(), graph.astype("<i4").tobytes(), entry]], columns=["dim", "band", "shard", "nodes", "vectors", "graph", "entry"])

    largest = F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    return (vectors.select(F.size("embedding").alias("dim"), F.floor(F.log2(largest) / BAND).cast("int").alias("band"),
                           F.expr(f"pmod(xxhash64(node, variant), {shards})").alias("shard"), "node", "variant", "embedding")
            .groupBy("dim", "band", "shard").applyInPandas(build, _SHARD))


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = 96, block_queries: int = 256) -> DataFrame:
    """queries: query_id, query_hash, embedding. The k nearest nodes of each shard for each query: node, variant, score (distance in double)."""
    blocks = max(1, -(-queries.count() // block_queries))
    packed = (queries.select(F.size("embedding").alias("dim"), F.expr(f"pmod(xxhash64(query_id, query_hash), {blocks})").alias("block"), "query_id", "query_hash", "embedding")
              .groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "query_hash", "embedding")).alias("queries")))
    shards = index.groupBy("dim").agg(F.collect_list(F.struct("band", "shard")).alias("shards"))
    asked = packed.join(shards, "dim").select("dim", "block", "queries", F.inline("shards"))
    names = ["query_id", "query_hash", "node", "variant", "score"]

    def search(pdf):
        out = []
        for r in pdf.itertuples():
            nodes = np.frombuffer(r.nodes, "<i8").reshape(-1, 2)
            exact = np.frombuffer(r.vectors, "<f8").reshape(len(nodes), -1)
            graph = np.frombuffer(r.graph, "<i4").reshape(len(nodes) + 1, -1).astype(np.int64)
            points = np.array([list(q["embedding"]) for q in r.queries], np.float64)
            scales = np.minimum(scale(exact), [scale(p) for p in points])
            for by in np.unique(scales):
                some = np.flatnonzero(scales == by)
                x, asked_points = np.ldexp(exact, by), np.ldexp(points[some], by)
                found, _ = beam_search(x, graph, int(r.entry), asked_points, max(beam, k))
                for i, point, own in zip(some, asked_points, found):
                    own = own[own >= 0]
                    score = np.ldexp(np.sqrt(((x[own] - point) ** 2).sum(1)), -by)
                    best = np.lexsort((nodes[own, 1], nodes[own, 0], score))[:k]
                    out.append(pd.DataFrame({"query_id": r.queries[i]["query_id"], "query_hash": r.queries[i]["query_hash"],
                                             "node": nodes[own[best], 0], "variant": nodes[own[best], 1], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})

    return (asked.join(index.hint("merge"), ["dim", "band", "shard"]).groupBy("dim", "band", "shard", "block")
            .applyInPandas(search, "query_id long, query_hash long, node long, variant long, score double"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_nodes: int = 4096, beam: int = 96) -> DataFrame:
    """The k nearest rows of vectors, other than its own, for each row of queries: query_id, rank int, id_col, score double, query_hash long."""
    take = lambda df: df.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    rows = take(vectors)
    asked = durable(take(queries).select(F.col("id").alias("query_id"), F.xxhash64("embedding").alias("query_hash"), "embedding").distinct())
    same = W.partitionBy("embedding")
    members = durable(rows.distinct().withColumn("variant", F.xxhash64("embedding")).withColumn("place", F.row_number().over(same.orderBy("id")))
                      .filter(F.col("place") <= k + 1).withColumn("node", F.min("id").over(same)))
    index = durable(build_index(members.filter("place = 1").select("node", "variant", "embedding"), shard_nodes))
    near = search_index(index, asked, k + 1, beam)
    query = W.partitionBy("query_id", "query_hash")
    near = near.withColumn("place", F.row_number().over(query.orderBy("score", "node", "variant"))).filter(F.col("place") <= k + 1)
    own = (F.col("id") == F.col("query_id")) & (F.col("variant") == F.col("query_hash"))
    ranked = (near.drop("place").join(members.select("node", "variant", "id"), ["node", "variant"]).filter(~own)
              .withColumn("rank", F.row_number().over(query.orderBy("score", "id", "variant"))).filter(F.col("rank") <= k))
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score", "query_hash")
