import numpy as np
from pyspark.sql import functions as F

from plumbline.llm.hnsw import op8_hnsw_search, search


def exact(vectors, queries, k=5):
    ids = np.asarray(sorted(vectors))
    m = np.asarray([vectors[i] for i in ids], np.float64)
    norms = np.linalg.norm(m, axis=1)
    out = {}
    for q in queries:
        s = m @ np.asarray(vectors[q], np.float64) / norms / np.linalg.norm(np.asarray(vectors[q], np.float64))
        order = [x for x in np.lexsort((ids, -s)) if ids[x] != q][:k]
        out[q] = [(int(ids[x]), float(s[x])) for x in order]
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    e = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = exact(e, [i for i in e if i % 50 == 0])
    got = {}
    for r in op8_hnsw_search(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want) and all([x[0] for x in v] == [1, 2, 3, 4, 5] for v in got.values())
    near = lambda q, v: any(i == v for i, _ in want[q])
    recall = np.mean([near(q, v) for q, x in got.items() for _, v, _ in x])
    assert recall >= 0.9, recall
    for q, x in got.items():
        for _, v, s in x:
            a, b = np.asarray(e[q], np.float64), np.asarray(e[v], np.float64)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_many_shards_and_ties(spark):
    r = np.random.default_rng(3)
    v = {i: r.normal(size=8).tolist() for i in range(600)}
    for i in range(100, 300):
        v[i] = v[7]
    df = spark.createDataFrame([(i, x) for i, x in v.items()], "vec_id long, embedding array<float>")
    v = {row["vec_id"]: row["embedding"] for row in df.collect()}
    want = exact(v, [i for i in v if i % 50 == 0])
    got = {}
    for row in search(df, df.where("vec_id % 50 = 0"), shard_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    assert got[150] == [7, 100, 101, 102, 103] and got[100] == [7, 101, 102, 103, 104]
    assert np.mean([i in got[q] for q, x in want.items() for i, _ in x]) > 0.95


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (50, [-2.0, 0.0]), (100, [0.0, 3.0, 1.0]), (8, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("ids", F.lit(2)).withColumn("v", F.lit(3))
    got = [tuple(r) for r in search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert [x[:3] for x in got] == [(0, 1, 1), (0, 2, 8), (0, 3, 50), (50, 1, 8), (50, 2, 0), (50, 3, 1)]
    assert search(df.limit(0), df.limit(0)).count() == 0 and search(df, df.limit(0)).count() == 0
