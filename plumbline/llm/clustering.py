"""Lloyd's clustering by differences (operator 11).

Components are integers, so sums and centroids are exact whatever the order of rows.
The state is a table: every vector with its owner and its distance to it.  A round reads
it once and writes the next one.  A vector whose owner stood still meets only the
centroids that moved; one whose owner moved meets all.  What a task sends on is a signed
sum a cluster: the vectors that came less those that left.  The global sums take these
in, so no round adds up all vectors again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import discard, materialise, read

#: Components from this magnitude on could bring a distance beyond a long.
WIDEST = 1 << 27
#: Up to this magnitude products of 64 components are exact in doubles.
EXACT = 1 << 23
_STATE = "kind int, vec_id long, v array<int>, owner int, distance long, transfer array<long>"


@dataclass(frozen=True)
class Clusters:
    """``assignments`` (vec_id, cluster, distance), and of each cluster its centroid, its vectors' sum and their number."""

    assignments: DataFrame
    centroids: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    rounds: int


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def whole_numbers(vectors: DataFrame, *, vec_id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of ``dim`` finite components as integers, rounded down after scaling."""
    x = F.col(vector)
    kept = vectors.where(x.isNotNull() & (F.size(x) == dim) & F.forall(x, _finite)).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    return kept.where(F.forall("v", lambda c: F.abs(c) < WIDEST)).select("vec_id", F.col("v").cast("array<int>").alias("v"))


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows (n x dim) to centroids (k x dim)."""
    small = len(v) and max(abs(int(v.min())), abs(int(v.max())), int(np.abs(centroids).max(initial=0))) <= EXACT and v.shape[1] <= 64
    if small:  # a product of matrices in doubles has no rounding here
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(v), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        gap = v.astype(np.int64) - c
        out[:, k] = (gap * gap).sum(1)
    return out


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances under ``centroids``, of which only ``changed`` differ from those of the last round.

    Ties go to the smaller number.
    """
    owner, distance = owner.copy(), distance.copy()
    moved = np.isin(owner, changed) | (owner < 0)
    if moved.any():
        d = squared_distances(v[moved], centroids)
        owner[moved] = d.argmin(1)
        distance[moved] = d.min(1)
    still = np.flatnonzero(~moved)
    if len(still) and len(changed):
        d = squared_distances(v[still], centroids[changed])
        best, at = d.min(1), changed[d.argmin(1)]
        better = (best < distance[still]) | ((best == distance[still]) & (at < owner[still]))
        owner[still[better]], distance[still[better]] = at[better], best[better]
    return owner, distance


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def _round(centroids: np.ndarray, changed: np.ndarray, dim: int):
    """A task of one round: its rows with their new owners, then a signed transfer (number, sums) a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        transfer = np.zeros((k, dim + 1), np.int64)
        names = [x.split()[0] for x in _STATE.split(", ")]
        for batch in batches:
            n = batch.num_rows
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            was, distance = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            owner, distance = reassigned(v, was, distance, centroids, changed)
            with_count = np.column_stack([np.ones(n, np.int64), v])
            for c in range(k):
                came, left = (owner == c) & (was != c), (was == c) & (owner != c)
                transfer[c] += with_count[came].sum(0) - with_count[left].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), pa.array(owner.astype(np.int32)), pa.array(distance), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        some = np.flatnonzero(transfer.any(1))
        if len(some):
            m = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), pa.array(some.astype(np.int32)), pa.nulls(m, pa.int64()), _lists(transfer[some], pa.int64())], names=names)

    return run


def _transfers(written: DataFrame, k: int, dim: int) -> np.ndarray:
    """The signed sums of all tasks: a number a cluster and component, whatever the rows."""
    each = written.where("kind = 1").select("owner", F.posexplode("transfer").alias("at", "x")).groupBy("owner", "at").agg(F.sum("x").alias("x"))
    out = np.zeros((k, dim + 1), np.int64)
    for r in each.collect():
        out[r["owner"], r["at"]] = r["x"]
    return out


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``; equal ids by vector.  A task sends at most ``k`` rows."""
    named = rows.where(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    return np.asarray([r["v"] for r in named.orderBy("hash", "v").limit(k).collect()], np.int64)


def delta_lloyd(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> Clusters:
    """Clusters of the vectors that have exactly ``dim`` components, none null or not finite.

    ``rounds`` times every vector goes to the nearest centroid (ties: the smaller number)
    and every centroid that has vectors becomes their mean, rounded down; then vectors go
    to the nearest once more.  Rounds end early when no centroid moves, as nothing would
    change after that.

    Rows that repeat an id or a vector each count.  A row with a null id is clustered but
    starts no centroid.  Vectors with a component of 2**27 or more after scaling take no
    part, as their distance need not fit a long.  Fewer vectors than ``k`` give as many
    centroids; empty tables, or none with an id, give empty results.  Extra columns are
    not read.
    """
    rows = whole_numbers(vectors, vec_id=vec_id, vector=vector, dim=dim, scale=scale)
    centroids = first_centroids(rows, k, seed)
    k = len(centroids)
    if not k:
        return Clusters(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, dim), np.int64), np.zeros((0, dim), np.int64), np.zeros(0, np.int64), 0)
    state, total, changed, done = rows.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance")), np.zeros((k, dim + 1), np.int64), np.arange(k), 0
    last = None
    for done in range(rounds + 1):
        written = materialise(state.mapInArrow(_round(centroids, changed, dim), _STATE), "lloyd")
        if last is not None:
            discard(last)
        last, state = written, written.where("kind = 0").select("vec_id", "v", "owner", "distance")
        total += _transfers(written, k, dim)
        if done == rounds:
            break
        full = total[:, 0] > 0
        new = centroids.copy()
        new[full] = total[full, 1:] // total[full, :1]
        changed = np.flatnonzero((new != centroids).any(1))
        centroids = new
        if not len(changed):
            break
    return Clusters(state.select("vec_id", F.col("owner").alias("cluster"), "distance"), centroids, total[:, 1:], total[:, 0], done)


def inertia(c: Clusters) -> DataFrame:
    """(cluster, cluster_inertia, inertia, centroid_sha256): a row a cluster; sums beyond a long are null."""
    spark = c.assignments.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in c.assignments.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(k, fits(sums.get(k, 0)), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for k, x in enumerate(c.centroids)]
    return spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    c = delta_lloyd(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return c.assignments.join(F.broadcast(inertia(c)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """All rounds written out; every round compares all vectors with all centroids and adds all of them up."""
    near = lambda t, c: f"{t} AS MATERIALIZED (SELECT vec_id, v, unnest(arg_min(struct_pack(c := c, d := d), d * {k} + c)) FROM (SELECT row, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM kept CROSS JOIN {c}) GROUP BY row, vec_id, v)"
    parts = [f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, w) - 1 AS c, w FROM (SELECT sha256('{seed}:' || vec_id) AS h, v AS w FROM kept ORDER BY h, w LIMIT {k}))"]
    for r in range(rounds):
        parts += [near(f"a{r}", f"c{r}"),
                  f"s{r} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dim})) AS i FROM a{r}) GROUP BY c, i)",
                  f"m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS w FROM s{r} GROUP BY c)",
                  f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c))"]
    parts.append(near("fin", f"c{rounds}"))
    return "WITH " + ", ".join(parts) + (f" SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM fin JOIN c{rounds} USING (c)")
