from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm.mixing import BUDGET, DIMENSIONS, TEMPER, mix, op9_mixing, op9_sql, sample

from .odd import SCHEMA, documents, empty, odd, odd_rows


def test_sql_and_marginals(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = op9_mixing(spark, sf)
    rows = [tuple(r) for r in got.collect()]
    cols = ", ".join(got.columns)
    assert sorted(rows, key=str) == sorted(duckdb.sql(f"SELECT {cols} FROM ({op9_sql()})").fetchall(), key=str)
    tokens, weight, total = defaultdict(float), defaultdict(float), sum(r[4] for r in rows)
    cells = {r[1:4]: r[5] for r in rows if r[4]}
    for r in rows:
        for k, d in enumerate(DIMENSIONS):
            tokens[d, r[1 + k]] += r[4]
    for cell, w in cells.items():
        for d, c in zip(DIMENSIONS, cell, strict=True):
            weight[d, c] += w
    for d in DIMENSIONS:
        norm = sum((t / total) ** TEMPER for (x, _), t in tokens.items() if x == d)
        for (x, c), t in tokens.items():
            if x == d and t:
                assert weight[x, c] == pytest.approx((t / total) ** TEMPER / norm, abs=1e-7)
    assert sum(r[4] * r[6] for r in rows) == pytest.approx(BUDGET * total, rel=1e-6)
    assert sum(r[4] for r in rows if r[7]) == pytest.approx(BUDGET * total, rel=0.1)
    assert sorted(r["doc_id"] for r in sample(documents(spark, sf)).select("doc_id").collect()) == sorted(r[0] for r in rows if r[7])


def test_given_targets(spark):
    sf = "/root/testdata/sf0.01"
    out = mix(documents(spark, sf), budget=0.3, targets={"lang": {"en": 0.7, "fr": 0.1, "de": 0.1, "es": 0.1}}, dimensions=("lang",))
    share = {r["lang"]: r["w"] for r in out.where("tokens > 0").groupBy("lang").agg(F.max("cell_weight").alias("w")).collect()}
    assert share["en"] == pytest.approx(0.7) and share["fr"] == pytest.approx(0.1)


def test_a_topic_of_the_caller(spark):
    """Long texts have no topic of their own; a column decides where one is given."""
    df = spark.createDataFrame([(k, "word " * (5000 if k % 2 else 5), "en", "s", "ab"[k % 2]) for k in range(20)], "doc_id long, text string, lang string, source string, t string")
    assert {r["topic"] for r in mix(df).collect()} == {"prose"}
    out = mix(df, topic=F.col("t"), targets={"topic": {"a": 0.5, "b": 0.5}}, dimensions=("topic",)).collect()
    assert {(r["topic"], round(r["cell_weight"], 9)) for r in out} == {("a", 0.5), ("b", 0.5)}


def test_targets_that_no_weights_meet(spark):
    """The gap that is left is told, not kept silent."""
    df = spark.createDataFrame([(k, "some words", "fr" if k < 5 else "en", "one" if k < 5 else "two") for k in range(20)], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="gap"):
        out = mix(df, targets={"lang": {"fr": 0.9, "en": 0.1}, "source": {"one": 0.5, "two": 0.5}}, dimensions=("lang", "source")).collect()
    assert {round(r["gap"], 6) for r in out} == {0.4}


def test_odd(spark):
    out = mix(odd(spark)).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["probability"] <= 1 for r in out)
    assert all(not r["sampled"] and r["probability"] == 0 for r in out if not r["tokens"])
    whole = sample(odd(spark), budget=1.0)
    assert whole.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert whole.count() == sum(bool(r["tokens"]) for r in out)
    assert mix(empty(spark)).count() == 0 and sample(empty(spark)).count() == 0
