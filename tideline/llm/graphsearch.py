"""Approximate nearest neighbours by inner product on robust-pruned graphs.

Equal vectors form a class; a class keeps as many of its smallest ids as an answer
can need, so a vector that a third of all rows share is one node. Classes are
dealt by hash to shards of about SHARD_ROWS nodes, or ROOT times the root of their
number if that is more: a search touches about as many nodes of a large shard as of
a small one, so all queries together cost the number of rows to the power 1.5, not
2. (Dealing vectors by nearness would save shards, but loses neighbours where
vectors have no clusters, as here.) In each shard a directed graph
is built: a greedy beam search from the most central node proposes neighbours for
every node, and a relaxed pruning keeps a neighbour only if no kept one is closer
to it by the factor alpha, so that edges point in diverse directions. Vectors get
one more dimension that makes all norms of a shard equal, so that the nearest by
distance is the largest by inner product.

Every query is searched in every shard with a beam of width BEAM. Queries come in
blocks, and an answer is merged from the shards' best in two steps. Scores are
inner products of the original vectors in double precision; ties go to the
smaller id. Every row is indexed, nothing is sampled.

Vectors that are null, zero, empty, or hold null or non-finite components take no
part, nor do rows with a null id. Vectors of different lengths aren't compared.
Rows that repeat the query's own id are no candidates for it. An empty table gives
no rows. Extra columns, of whatever names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import counted, durable
from tideline.llm.textbatch import release

NEIGHBOURS = 20
SHARD_ROWS = 16_384
ROOT = 64
DEGREE = 24
BUILD_BEAM = 48
BEAM = 192  # of shards of SHARD_ROWS; that of larger ones grows as the fourth root of their size
ALPHAS = (1.0, 1.2)
BLOCK_ROWS = 256
WIDTH = 4  # nodes that one step of a search expands


def usable(column: str) -> Column:
    return F.expr(f"coalesce(size({column}) > 0 AND forall({column}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({column}, x -> x <> 0), false)")


def lifted(vectors: np.ndarray) -> np.ndarray:
    """float32 vectors with one more component that makes their norms equal."""
    v = vectors.astype(np.float64)
    square = (v * v).sum(1)
    return np.column_stack((v, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0)))).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes of each query and their distances, nearest first; -1 and
    infinity fill up. The answer holds all nodes that a beam has kept."""
    q, n = len(queries), len(x)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], seen[:, entry] = entry, True
    dist[:, 0] = ((queries - x[entry]) ** 2).sum(1)
    norm, own = (x * x).sum(1), (queries * queries).sum(1)
    rows = np.arange(q)
    while len(rows):
        open_dist = np.where(done[rows] | (ids[rows] < 0), np.inf, dist[rows])
        best = np.argpartition(open_dist, min(WIDTH, beam - 1), axis=1)[:, :WIDTH]
        ready = np.isfinite(np.take_along_axis(open_dist, best, 1))
        live = ready.any(1)
        rows, best, ready = rows[live], best[live], ready[live]
        if not len(rows):
            break
        done[rows[:, None], best] |= ready
        chosen = np.where(ready, ids[rows[:, None], best], -1)
        near = np.where(chosen[..., None] >= 0, graph[chosen], -1).reshape(len(rows), -1)
        # A node that two expanded nodes share counts once.
        near.sort(1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[rows[:, None], near]
        r, c = np.nonzero(fresh)
        node = near[r, c]
        seen[rows[r], node] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = norm[node] + own[rows[r]] - 2 * np.einsum("ij,ij->i", x[node], queries[rows[r]])
        all_d = np.concatenate((dist[rows], d), 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        all_ids = np.concatenate((ids[rows], np.where(fresh, near, -1)), 1)
        all_done = np.concatenate((done[rows], ~fresh), 1)
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_d, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of each node from its row of candidates (-1: none)."""
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    candidates = np.sort(candidates, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    c = x[candidates]
    norm = np.einsum("ijk,ijk->ij", c, c)
    between = norm[:, :, None] + norm[:, None, :] - 2 * c @ c.transpose(0, 2, 1)
    d = ((c - x[nodes][:, None]) ** 2).sum(2)
    d[candidates < 0] = np.inf
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    left = d.copy()
    for k in range(degree):
        pick = left.argmin(1)
        ok = np.isfinite(left[rows, pick])
        if not ok.any():
            break
        out[ok, k] = candidates[rows[ok], pick[ok]]
        left[rows, pick] = np.inf
        covered = alpha * alpha * between[rows, pick] <= d
        left[covered & ok[:, None]] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 5) -> tuple[np.ndarray, int]:
    """Out-edges (n x degree, -1: none) and the entry node of lifted vectors."""
    n, rng = len(x), np.random.default_rng(seed)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = rng.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    for alpha in ALPHAS:
        order = rng.permutation(n)
        for lo in range(0, n, BLOCK_ROWS):
            nodes = order[lo : lo + BLOCK_ROWS]
            found, _ = beam_search(x, graph, entry, x[nodes], beam)
            graph[nodes] = robust_prune(x, nodes, np.concatenate((found, graph[nodes]), 1), degree, alpha)
            # Backward edges, pruned where a node has too many.
            src, dst = np.repeat(nodes, degree), graph[nodes].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            target, first, count = np.unique(dst, return_index=True, return_counts=True)
            extra = np.full((len(target), int(count.max(initial=0))), -1, np.int64)
            extra[np.repeat(np.arange(len(target)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            for at in range(0, len(target), BLOCK_ROWS):
                t = target[at : at + BLOCK_ROWS]
                wide = np.concatenate((graph[t], extra[at : at + BLOCK_ROWS]), 1)
                wide = wide[:, : max(degree, int((wide >= 0).sum(1).max(initial=0)) + degree)]
                graph[t] = robust_prune(x, t, wide, degree, alpha)
    return connected(x, graph, entry), entry


def connected(x: np.ndarray, graph: np.ndarray, entry: int) -> np.ndarray:
    """The graph with one more column, in which the nearest node that the entry
    reaches points to a node that it didn't reach, until it reaches all."""
    seen = np.zeros(len(x), bool)

    def visit(fresh):
        while len(fresh):
            seen[fresh] = True
            fresh = np.unique(graph[fresh])
            fresh = fresh[fresh >= 0]
            fresh = fresh[~seen[fresh]]

    visit(np.array([entry]))
    more = np.full(len(x), -1, np.int64)
    while not seen.all():
        lost = int(np.flatnonzero(~seen)[0])
        near = np.flatnonzero(seen & (more < 0))
        more[near[((x[near] - x[lost]) ** 2).sum(1).argmin()]] = lost
        visit(np.array([lost]))
    return np.column_stack((graph, more))


_SHARD = "shard long, dim int, vectors binary, ids array<array<long>>, graph binary, entry int"


def classes_of(rows: DataFrame, keep: int, salts: int = 256) -> DataFrame:
    """(embedding, ids) of distinct usable vectors; the keep smallest ids of each.
    Salted groups shrink to keep ids before a class meets."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, keep).alias("ids")
    salted = rows.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(least(F.collect_list("vec_id")))
    return salted.groupBy("embedding").agg(least(F.flatten(F.collect_list("ids"))))


def index(classes: DataFrame, shards: int) -> DataFrame:
    """One row per shard (and length of vectors) with its graph."""

    def build(key, table):
        v = np.array(table.column("embedding").to_pylist(), np.float32)
        by = np.lexsort(v.T[::-1])  # the graph doesn't depend on the order of rows
        ids = table.column("ids").to_pylist()
        graph, entry = build_graph(lifted(v[by]))
        release()
        return pa.table({"shard": [key[0].as_py()], "dim": pa.array([v.shape[1]], pa.int32()), "vectors": [v[by].tobytes()], "ids": pa.array([[ids[i] for i in by]], pa.list_(pa.list_(pa.int64()))), "graph": [graph.astype(np.int32).tobytes()], "entry": pa.array([entry], pa.int32())})

    return classes.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).alias("shard"), F.size("embedding").alias("dim"), "embedding", "ids").groupBy("shard", "dim").applyInArrow(build, _SHARD)


def search(rows: DataFrame, queries: Column, k: int = NEIGHBOURS, shard_rows: int | None = None, beam: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row (vec_id,
    embedding) for which the condition queries holds, among all other rows."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable("embedding"))
    keep = k + 1
    classes, seen = counted(classes_of(rows, keep), "vectors", n=F.count("*"))
    shard_rows = shard_rows or max(SHARD_ROWS, int(ROOT * seen["n"] ** 0.5))
    shards = seen["n"] // shard_rows + 1
    beam = beam or int(BEAM * max(1.0, shard_rows / SHARD_ROWS) ** 0.25)
    graphs = durable(index(classes, shards), "graphs")
    asking = rows.filter(queries)
    wanted, seen = counted(asking.select("embedding").distinct().join(classes, "embedding").select(F.col("ids")[0].alias("cid"), "embedding"), "queries", n=F.count("*"))
    blocks = seen["n"] // (2 * BLOCK_ROWS) + 1
    blocked = wanted.groupBy(F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("block"), F.size("embedding").alias("dim")).agg(F.collect_list(F.struct("cid", "embedding")).alias("asked"))
    placed = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).join(graphs, ["shard", "dim"])

    def answer(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                dim = row["dim"].as_py()
                v = np.frombuffer(row["vectors"].as_py(), np.float32).reshape(-1, dim)
                ids, asked = row["ids"].as_py(), row["asked"].as_py()
                q = np.array([a["embedding"] for a in asked], np.float32)
                found = _nearest(v, np.frombuffer(row["graph"].as_py(), np.int32).reshape(len(v), -1).astype(np.int64), row["entry"].as_py(), q, beam)
                out = []
                for a, near in zip(asked, found):
                    near = near[near >= 0]
                    score = v[near].astype(np.float64) @ np.array(a["embedding"], np.float64)
                    best = sorted((-s, i) for s, c in zip(score.tolist(), near.tolist()) for i in ids[c])[:keep]
                    out.append((a["cid"], row["shard"].as_py(), [-s for s, _ in best], [i for _, i in best]))
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["cid", "shard", "scores", "ids"])

    found = placed.select("shard", "dim", "vectors", "ids", "graph", "entry", "asked").mapInArrow(answer, "cid long, shard long, scores array<double>, ids array<long>")
    # The least by (-score, id) come first.
    found = found.select("cid", "shard", F.expr("transform(arrays_zip(scores, ids), x -> struct(-x.scores AS minus, x.ids AS vec_id))").alias("best"))
    least = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, keep).alias("best")
    halfway = max(1, int(shards**0.5))
    merged = found.groupBy("cid", F.pmod("shard", F.lit(halfway)).alias("part")).agg(least).groupBy("cid").agg(least)
    answers = wanted.join(merged, "cid").select("embedding", "best")
    own = asking.select(F.col("vec_id").alias("query_id"), "embedding").distinct().join(answers, "embedding")
    top = own.select("query_id", F.expr(f"slice(filter(best, x -> x.vec_id <> query_id), 1, {k})").alias("best"))
    rows_out = top.select("query_id", F.posexplode("best").alias("at", "x"))
    return rows_out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def _nearest(v: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    x = lifted(v)
    zero = np.zeros((len(queries), 1), np.float32)
    # Scaling a query doesn't change the order of inner products, but keeps distances exact.
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(1, keepdims=True))
    scale = np.sqrt((x[0].astype(np.float64) ** 2).sum()) / np.maximum(length, 1e-30)
    return np.concatenate([beam_search(x, graph, entry, np.column_stack(((queries[i : i + BLOCK_ROWS] * scale[i : i + BLOCK_ROWS]).astype(np.float32), zero[i : i + BLOCK_ROWS])), beam)[0] for i in range(0, len(queries), BLOCK_ROWS)])
