"""Approximate nearest neighbours by one small-world graph per shard (operator 8).

Equal vectors are one node, so a vector that a third of all rows hold is indexed once.
Every shard's hierarchical graph is a row of flat arrays.  Queries go to the shards: each
shard's task reads its graph once and walks it for all its queries, and the shards' best
are merged.  Shards grow with the root of the number of vectors, so they become fewer in
proportion; the work is that of a stated query set against all of them.
"""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import materialise, read

#: Queries that meet a shard in one group, rows of the largest shard, tasks of one step.
SLICE, LARGEST, MOST_TASKS = 16_384, 32_768, 20_000
_GRAPH = "dim int, shard int, n int, ids binary, vectors binary, levels binary, neighbours binary"


class Graph:
    """A hierarchical navigable small-world graph over unit vectors.

    ``neighbours[level]`` is an array of one row of node numbers per node (-1: none);
    a node of top level L has rows in levels 0 to L.
    """

    def __init__(self, unit: np.ndarray, m: int, ef: int, seed: int = 7):
        n = len(unit)
        self.v, self.m, self.ef = unit, m, ef
        self.top = np.minimum((-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / np.log(m)).astype(np.int8), 12)
        self.neighbours = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(int(self.top.max()) + 1)]
        self.stamp, self.clock, self.entry = np.zeros(n, np.int64), 0, 0
        for node in range(1, n):
            self._insert(node)

    @classmethod
    def load(cls, unit: np.ndarray, neighbours: list[np.ndarray], entry: int) -> Graph:
        g = cls.__new__(cls)
        g.v, g.neighbours, g.entry, g.stamp, g.clock = unit, neighbours, entry, np.zeros(len(unit), np.int64), 0
        return g

    def near(self, q: np.ndarray, start: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` most similar nodes that a best-first walk of one level finds, (similarity, node)."""
        self.clock += 1
        stamp, clock, adj, v = self.stamp, self.clock, self.neighbours[level], self.v
        sims = (v[start] @ q).tolist()
        stamp[start] = clock
        best = list(zip(sims, start, strict=True))
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        todo = [(-s, x) for s, x in zip(sims, start, strict=True)]
        heapq.heapify(todo)
        while todo:
            s, x = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= ef:
                break
            row = adj[x]
            row = row[row >= 0]
            row = row[stamp[row] != clock]
            if not len(row):
                continue
            stamp[row] = clock
            for t, y in zip((v[row] @ q).tolist(), row.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (t, y))
                    heapq.heappush(todo, (-t, y))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, y))
                    heapq.heappush(todo, (-t, y))
        return best

    def _choose(self, node: int, found: list[tuple[float, int]], most: int) -> list[int]:
        """Nodes that are more similar to ``node`` than to any chosen before; filled up with the nearest others."""
        found = sorted(found, reverse=True)
        if len(found) <= most:
            return [x for _, x in found]
        ids = np.fromiter((x for _, x in found), np.int64, len(found))
        between = self.v[ids] @ self.v[ids].T
        kept: list[int] = []
        for k, (s, _) in enumerate(found):
            if not kept or between[k, kept].max() < s:
                kept.append(k)
                if len(kept) == most:
                    break
        rest = [k for k in range(len(found)) if k not in set(kept)]
        return ids[kept + rest[: most - len(kept)]].tolist()

    def _insert(self, node: int) -> None:
        q, start, top = self.v[node], [self.entry], int(self.top[node])
        highest = int(self.top[self.entry])
        for level in range(highest, top, -1):
            start = [max(self.near(q, start, 1, level))[1]]
        for level in range(min(top, highest), -1, -1):
            found = self.near(q, start, self.ef, level)
            adj, room = self.neighbours[level], self.neighbours[level].shape[1]
            chosen = self._choose(node, found, self.m)
            adj[node, : len(chosen)] = chosen
            for x in chosen:
                row = adj[x]
                full = int((row >= 0).sum())
                if full < room:
                    row[full] = node
                else:
                    near = np.append(row, node)
                    keep = self._choose(x, list(zip((self.v[near] @ self.v[x]).tolist(), near.tolist(), strict=True)), room)
                    adj[x] = keep
            start = [x for _, x in found]
        if top > highest:
            self.entry = node

    def search(self, q: np.ndarray, ef: int) -> list[int]:
        start = [self.entry]
        for level in range(len(self.neighbours) - 1, 0, -1):
            start = [max(self.near(q, start, 1, level))[1]]
        return [x for _, x in self.near(q, start, ef, 0)]


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


def usable(vector: str):
    """Not null, not zero, all components finite."""
    x = F.col(vector)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite) & F.exists(x, lambda c: c != 0)


def _build(m: int, ef: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        g = Graph(_unit(v), m, ef)
        rows = {"dim": key[0], "shard": key[1], "n": len(v), "ids": pdf["rep"].to_numpy(np.int64).tobytes(), "vectors": v.tobytes(),
                "levels": np.asarray([g.entry, *[x.shape[1] for x in g.neighbours]], np.int64).tobytes(), "neighbours": b"".join(x.tobytes() for x in g.neighbours)}
        return pd.DataFrame([rows])

    return run


def _load(n: int, dim: int, vectors: bytes, levels: bytes, neighbours: bytes) -> tuple[np.ndarray, Graph]:
    v = np.frombuffer(vectors, np.float64).reshape(n, dim)
    entry, *widths = np.frombuffer(levels, np.int64).tolist()
    flat, at, out = np.frombuffer(neighbours, np.int32), 0, []
    for w in widths:
        out.append(flat[at : at + n * w].reshape(n, w))
        at += n * w
    return v, Graph.load(_unit(v), out, entry)


def _search(k: int, ef: int):
    """The ``k`` best of one shard for each query of a group, by their exact cosines."""

    def run(key: tuple, graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(graph) and len(queries):
            r = graph.iloc[0]
            v, g = _load(r["n"], r["dim"], r["vectors"], r["levels"], r["neighbours"])
            ids, norms = np.frombuffer(r["ids"], np.int64), np.linalg.norm(v, axis=1)
            qs = np.stack(queries["v"].to_numpy()).astype(np.float64)
            for q_id, q, u in zip(queries["id"].tolist(), qs, _unit(qs), strict=True):
                found = np.asarray(g.search(u, ef))
                exact = (v[found] @ q) / (norms[found] * np.linalg.norm(q))
                out += [(q_id, int(ids[found[x]]), float(exact[x])) for x in np.lexsort((ids[found], -exact))[:k]]
        return pd.DataFrame(out, columns=["query_id", "rep", "score"]).astype({"query_id": "int64", "rep": "int64", "score": "float64"})

    return run


def shards_of(n: int, shard_rows: int) -> int:
    """Shards of ``shard_rows`` vectors; of more where there are over (``shard_rows`` / 4) squared of them."""
    return max(1, -(-n // max(shard_rows, min(LARGEST, int(4 * n**0.5)))))


def build(vectors: DataFrame, *, vec_id: str, vector: str, k: int, shard_rows: int, m: int, ef: int) -> tuple[DataFrame, DataFrame, int]:
    """(members, graphs, number of shards).  ``members`` has each distinct vector's ``k`` + 1 smallest ids."""
    rows = vectors.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).select("id", F.transform("v", lambda x: x + 0.0).alias("v"))
    # rank is limited before the shuffle: of a vector that many rows hold, each task sends k + 1 rows
    first = Window.partitionBy("v").orderBy("id")
    ranked = rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)
    members = materialise(ranked.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_set("id")).alias("ids")), "hnsw-members")
    shards = shards_of(members.count(), shard_rows)
    shard = F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")
    rows = members.select(F.size("v").alias("dim"), shard.alias("shard"), "rep", "v").repartitionByRange(min(shards, MOST_TASKS), "dim", "shard")  # a shard a task
    graphs = rows.groupBy("dim", "shard").applyInPandas(_build(m, ef), _GRAPH)
    return members, materialise(graphs, "hnsw-graphs"), shards


def search(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = 4096, m: int = 12, ef_build: int = 48,
           ef_search: int = 96) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, itself left out.

    Nearness is cosine in double precision; ties go to the smaller id.  Vectors that are
    null, zero or hold null or non-finite components take no part; vectors of different
    lengths do not meet; long ones cost in proportion to their length.  Rows that repeat
    an id and a vector count once.  A query with no candidate has no row; empty tables
    give empty results; extra columns are not read.
    """
    members, graphs, shards = build(vectors, vec_id=vec_id, vector=vector, k=k, shard_rows=shard_rows, m=m, ef=ef_build)
    q = queries.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    slices = max(1, -(-q.count() // SLICE))
    key, tasks = ("dim", "shard", "slice"), min(2 * shards * slices, MOST_TASKS)
    index = graphs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(tasks, *key)
    asked = q.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), "id", "v").repartition(tasks, *key)
    found = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search(k + 1, ef_search), "query_id long, rep long, score double")
    each = found.join(members.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth embedding, over all embeddings."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(e, e.where(F.col("vec_id") % 50 == 0))
