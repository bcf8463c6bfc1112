import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.clustering import delta_lloyd, inertia, op11_delta_lloyd, op11_sql, reassigned, squared_distances

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance int, kind int, v string, owner string"
EXTRA = (7, 8, 9, "v", "o")


def plain(rows, k=8, rounds=10, dim=64):
    """Lloyd's rounds in Python's integers."""
    kept = []
    for i, x in rows:
        if x is None or len(x) != dim or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = [int(np.floor(1024 * float(np.float32(c)))) for c in x]
        if all(abs(c) < 1 << 27 for c in v):
            kept.append((i, v))
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    if not centres:
        return []
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, o) in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    own = assign()
    total = sum(d for d, _ in own)
    by = [sum(d for d, o in own if o == j) for j in range(len(centres))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, o, d, fits(by[o]), fits(total), name[o]) for (i, _), (d, o) in zip(kept, own)]


def found(df, **how):
    c = delta_lloyd(df, **how)
    return [tuple(r) for r in c.assignments.join(inertia(c), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = op11_delta_lloyd(spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({op11_sql()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_query_against_plain_rounds(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, op11_delta_lloyd(spark, "/root/testdata/sf0.001").collect())) == sorted(plain(rows))


def test_odd(spark):
    r = np.random.default_rng(5)
    some = [[float(np.float32(c)) for c in r.normal(size=64)] for _ in range(30)]
    rows = [(k, v) for k, v in enumerate(some)] + [(k, some[3]) for k in range(100, 160)]  # one vector, very often
    rows += [(1, some[1]), (2, some[5]), (None, some[0]), (None, [0.5] * 64), (40, None), (41, []), (42, [1.0] * 63), (43, [float("nan")] + [0.0] * 63), (44, [float("inf")] * 64), (45, [None] + [0.0] * 63),
             (46, [0.0] * 64), (47, [-0.0] * 64), (48, [1e30] + [0.0] * 63), (49, [131071.0] * 64), (50, [-131071.0] * 64), (51, [8000.25] * 64)]
    df = spark.createDataFrame([(*x, *EXTRA) for x in rows], SCHEMA).repartition(3)
    assert sorted(found(df), key=str) == sorted(plain(rows), key=str)
    few = df.where("vec_id < 5")
    assert sorted(found(few), key=str) == sorted(plain([x for x in rows if x[0] is not None and x[0] < 5]), key=str)
    assert found(df.limit(0)) == [] and found(df.where("vec_id IS NULL")) == [] and found(df.where("vec_id = 40")) == []


def test_sums_are_those_of_the_last_assignment(spark):
    """Signed transfers, added up over the rounds, give each cluster's own sum and number."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(5)
    c = delta_lloyd(e, rounds=4)
    v = e.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("v")).join(c.assignments, "vec_id").collect()
    for k in range(8):
        mine = np.asarray([r["v"] for r in v if r["cluster"] == k], np.int64).reshape(-1, 64)
        assert len(mine) == c.counts[k] and (mine.sum(0) == c.sums[k]).all()


def test_only_changed_centroids_are_compared():
    r = np.random.default_rng(2)
    v, old = r.integers(-50, 50, (400, 6)), r.integers(-50, 50, (5, 6))
    d = squared_distances(v, old)
    owner, distance = d.argmin(1), d.min(1)
    for changed in ([], [2], [0, 4], [0, 1, 2, 3, 4]):
        new = old.copy()
        new[changed] += r.integers(-20, 20, (len(changed), 6))
        o, s = reassigned(v, owner, distance, new, np.asarray(changed, np.int64))
        full = squared_distances(v, new)
        assert (o == full.argmin(1)).all() and (s == full.min(1)).all()
    big = r.integers(-(1 << 27) + 1, 1 << 27, (20, 64))
    assert (squared_distances(big, big[:3]) == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in big[:3]] for x in big]).all()
