"""The estimators against closed forms and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import filters, quality, simulate, site_effect, windows
from plumbline.operators.models import Options, fit_clinical, fit_model, fit_pairwise, prepared
from plumbline.operators.regression import Covariates, fit
from plumbline.operators.tuning import candidates, tune
from plumbline.sources import cohort, observations, sinks
from plumbline.streaming.harmonize import apply_stream, drift

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    df = cohort.cohort(spark, SF).toPandas()
    return spark.createDataFrame(df).coalesce(2).cache()


def test_least_squares(spark):
    r = np.random.default_rng(0)
    n = 60
    age, sex, hand = r.uniform(20, 80, n), r.integers(1, 3, n), r.integers(1, 3, n)
    y = r.normal(size=n)
    df = spark.createDataFrame([("b", float(y[k]), float(age[k]), int(sex[k]), int(hand[k])) for k in range(n)] + [("b", float("nan"), 1.0, 1, 1), ("flat", 1.0, 5.0, 1, 1)], "bundle string, mean double, age double, sex int, handedness int")
    x = np.column_stack([np.ones(n), sex == 2, hand == 2, age, age**2]).astype(float)
    got = {row["bundle"]: row for row in fit(df, Covariates(2)).collect()}
    assert np.allclose([got["b"][c] for c in ("intercept", "beta_sex", "beta_handedness", "beta_age1", "beta_age2")], np.linalg.solve(x.T @ x, x.T @ y), rtol=1e-8)
    assert got["flat"]["beta_age2"] is None and got["b"]["n"] == n


def test_known_models(rows):
    """Constants of independent implementations on these tables."""
    ref, mov = cohort.reference(rows), cohort.moving(rows)
    p = {r["bundle"]: r for r in fit_pairwise(ref, mov, Options(degree=1)).params.collect()}["ECONOMY"]
    want = {"intercept": 74.3766, "beta_sex": 0.56797, "beta_handedness": 1.75166, "beta_age1": 0.133654, "sigma": 26.067900, "mov_gamma": 21.976034, "mov_delta": 0.774733, "ref_gamma": -17.839548, "ref_delta": 0.515399}
    assert all(p[k] == pytest.approx(v, rel=1e-4) for k, v in want.items())
    m = fit_clinical(ref, mov, Options(degree=2))
    assert m.meta["regul_mov"] == 0.01
    c = {r["bundle"]: r for r in m.params.collect()}["LARGE"]
    assert c["ref_std"] == pytest.approx(13.110181, rel=1e-6) and c["mov_delta"] == pytest.approx(1.475597, rel=1e-6) and abs(c["mov_gamma"]) < 1e-9
    cov = Covariates(2)
    for lo, hi, ridge in ((30, 36, 9.852612533569339), (40, 46, 0.015)):
        assert tune(ref, mov.where(F.col("age").between(lo, hi - 1)), cov, ridge_ref=0.0, tau=2.0).first()["ridge"] == pytest.approx(ridge)
    assert len(candidates()) == 69
    before, after = (quality.summary(quality.check(m, ref, x)).first()["mean"] for x in (mov, m.apply(mov)))
    assert before > 0.5 and after < 0.01
    text = sinks.model_text(m)
    again = sinks.read_model(rows.sparkSession, text)
    assert sorted(map(tuple, again.params.select(*m.params.columns).collect())) == sorted(map(tuple, m.params.collect()))


def test_same_site_stays(rows):
    """A moving site equal to the reference is hardly moved; corrupting by nothing changes nothing."""
    ref = filters.controls(cohort.reference(rows))
    m = fit_pairwise(ref, ref.withColumn("site", F.lit("copy")), Options(degree=1, bayes=False))
    both = m.apply(ref).select("sid", "bundle", F.col("mean").alias("y")).join(ref, ["sid", "bundle"])
    assert both.agg(F.max(F.abs(F.col("y") - F.col("mean")))).first()[0] < 1e-8
    same = simulate.corrupt(ref, Covariates(1), mult=100, add=100, slope=100).select("sid", "bundle", F.col("mean").alias("y")).join(ref, ["sid", "bundle"])
    assert same.agg(F.max(F.abs(F.col("y") - F.col("mean")))).first()[0] < 1e-8


def test_bayes_against_a_plain_loop(spark):
    r = np.random.default_rng(2)
    g0, s0, n = r.normal(1, 0.5, 7), r.uniform(0.5, 2, 7), r.integers(10, 40, 7).astype(float)
    df = spark.createDataFrame([(f"b{k}", int(n[k]), float(g0[k]), float(s0[k])) for k in range(7)], "bundle string, n int, gamma_hat double, delta_hat double")
    d0 = s0**2
    m, v, t2 = d0.mean(), d0.var(ddof=1), g0.var(ddof=1)
    a, b = (2 * v + m * m) / v, (m * v + m**3) / v
    g, d = g0, d0
    for _ in range(1000):
        g2 = (t2 * n * g0 + d * g0.mean()) / (t2 * n + d)
        d2 = (((n - 1) * d0 + n * (g0 - g2) ** 2) / 2 + b) / (n / 2 + a - 1)
        change = max((abs(g2 - g) / g).max(), (abs(d2 - d) / d).max())
        g, d = g2, d2
        if change <= 1e-4:
            break
    got = sorted(map(tuple, site_effect.empirical_bayes(df).select("bundle", "gamma_star", "delta_star").collect()))
    assert np.allclose([x[1:] for x in got], np.column_stack([g, np.sqrt(d)]), rtol=1e-9)
    one = site_effect.empirical_bayes(df.limit(1)).first()
    assert math.isnan(one["gamma_star"]) and math.isnan(one["delta_star"])


def test_guards(spark, rows):
    with pytest.raises(ValueError):
        Options(tau=0.5)
    with pytest.raises(ValueError):
        fit_model("other", rows, rows)
    with pytest.raises(ValueError, match="handedness"):
        observations.require(rows.drop("handedness"))
    with pytest.raises(ValueError):
        filters.require_single(rows, "site")
    one = rows.withColumn("sex", F.when(F.col("bundle") == "LARGE", 1).otherwise(F.col("sex")))
    assert filters.usable_covariates(one) == {"sex": False, "handedness": True}
    with pytest.raises(ValueError, match="sex"):
        filters.usable_covariates(rows.withColumn("sex", F.lit(3)))
    assert filters.choose_bundles(["a", "skeleton_b"]) == ["skeleton_b"] and filters.choose_bundles(["b", "a"], ["x"]) == ["a"] and filters.choose_bundles(["b", "a"], "all") == ["a", "b"]


def test_windows_of_few_rows(spark):
    """A window of exactly the least number is left out; others widen until they have it, at most 50 years."""
    ages = [20.0, 20.0, 23.0, 30.0, 31.0, 99.0]
    df = spark.createDataFrame([("b", a, float(k), k) for k, a in enumerate(ages)], "bundle string, age double, mean double, sid int")
    for least in (1, 2, 3, 7):
        want = {}
        for c in range(20, 99):
            inside = [a for a in ages if abs(a - c) <= 2]
            steps = 0
            if len(inside) == least:
                continue
            while len(inside) < least and steps < 50:
                steps += 1
                inside = [a for a in ages if abs(a - c) <= 2 + steps]
            if inside:
                want[c] = (steps, len(inside))
        got = {r["centre"]: (r["widened"], r["n"]) for r in windows.windows(df, width=4, least=least).groupBy("centre", "widened").agg(F.count("*").alias("n")).collect()}
        assert got == want


def test_loading(spark, tmp_path):
    head = "sid,site,bundle,metric,mean,age,sex,handedness,disease\n"
    (tmp_path / "a.csv").write_text(head + "s1,1,b,md,0.5,30,1,2,NC\ns1,1,b,md,0.7,30,1,2,HC\ns2,1,b,md,,40,2,1,HC\ns2,1,b,md,0.9,40,2,1,HC\n")
    (tmp_path / "b.csv").write_text(head + "s1,1,b,md,0.5,30,1,2,HC\n")
    one = observations.load_results(spark, f"file://{tmp_path}/a.csv").collect()
    assert [(r["sid"], r["mean"], r["site"], r["disease"], r["harmonization"], r["model"], r["input"]) for r in one] == [("s1", 0.5, "1", "HC", "raw", "raw", "a.csv")]
    assert observations.load_sites(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"]).count() == 2


def test_stream(spark, rows, tmp_path):
    ref, mov = cohort.reference(rows), cohort.moving(rows)
    model = fit_pairwise(ref, mov, Options(degree=1))
    mov.write.parquet(f"{tmp_path}/in")
    stream = apply_stream(model, spark.readStream.schema(mov.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    pick = lambda df: sorted((r["sid"], r["bundle"], round(r["mean"], 6)) for r in df.collect())
    assert pick(spark.read.parquet(f"{tmp_path}/out")) == pick(model.apply(mov))


def test_plots_merge(spark):
    p = "bundle string, metric string, plot string"
    old, new = spark.createDataFrame([("a", "m", "1"), ("b", "m", "2")], p), spark.createDataFrame([("a", "m", "3")], p)
    assert sorted(map(tuple, sinks.merge_plots(old, new).collect())) == [("a", "m", "3"), ("b", "m", "2")]


def test_age_limit_is_of_all_moving_rows(rows):
    """Patients of more ages than the controls widen the range of the reference."""
    ref, mov = cohort.reference(rows), rows.where(F.col("site") == cohort.MOVING)
    mov = mov.where(F.when(F.col("disease") == "HC", F.col("age").between(40, 50)).otherwise(F.col("age").between(30, 60)))
    p = prepared(ref, mov, Options(limit_age=True), 1)
    least, most = mov.agg(F.min("age"), F.max("age")).first()
    assert tuple(p.ref.agg(F.min("age"), F.max("age")).first()) == (least, most) and least < 40 and most > 50
    assert (p.meta["min_age"], p.meta["max_age"]) == (40.0, 50.0) and p.mov.where("disease <> 'HC'").isEmpty()
    for wrong in (rows, mov.withColumn("metric", F.lit("other")), mov.withColumn("bundle", F.lit("none"))):
        with pytest.raises(ValueError):
            prepared(ref, wrong, Options(), 1)


def test_plots_nest_and_files_keep_their_order(spark, tmp_path):
    p = spark.createDataFrame([("a", "m", '{"x":[1,2]}'), ("b", "m", '{"x":[]}')], "bundle string, metric string, plot string")
    assert sorted(map(tuple, sinks.read_plots(spark, sinks.nested_plots(p)).collect())) == sorted(map(tuple, p.collect()))
    head = "sid,site,bundle,metric,mean,age,sex,handedness,disease\n"
    for k, folder in enumerate(("one", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.csv").write_text(head + f"s1,1,b,md,0.{k + 1},30,1,2,HC\n")
    paths = [f"file://{tmp_path}/{x}/same.csv" for x in ("one", "two")]
    assert [[r["mean"] for r in observations.load_sites(spark, x).collect()] for x in (paths, paths[::-1])] == [[0.1], [0.2]]
    out = f"file://{tmp_path}/out"
    sinks.write_csv(spark.createDataFrame([("s2", "x", "b"), ("s1", "x", "b")], "sid string, site string, bundle string"), out)
    assert [r["sid"] for r in spark.read.option("header", True).csv(out).collect()] == ["s1", "s2"]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_csv(p.select("bundle"), out)


def test_pairwise_text_of_older_files(spark):
    """A header with the other method's ridges reads as well."""
    text = "# {'name': 'pairwise', 'ignore_sex_covariate': False, 'ignore_handedness_covariate': True, 'degree': 1, 'regul_ref': 0, 'regul_mov': 0}\nbundle_names,b1,b2\nintercept,1.0,2.0\nbeta_sex,0.1,0.2\nbeta_age1,0.01,0.02\nsigma,1,2\nref_gamma,0,0\nref_delta,1,1\nmov_gamma,3,4\nmov_delta,1,2\n"
    m = sinks.read_model(spark, text)
    assert [(r["bundle"], r["beta_age1"], r["mov_delta"]) for r in m.params.orderBy("bundle").collect()] == [("b1", 0.01, 1.0), ("b2", 0.02, 2.0)]
    assert m.curve(F.array(F.lit(10))).where("bundle = 'b1'").first()["value"] == pytest.approx(1.0 + 0.05 + 0.1)


def test_file_order_over_many_splits(spark, tmp_path):
    """Keep-first and the order of results are those of the file, though it is read in many splits."""
    lines, first = [], {}
    for k in range(3000):
        sid, bundle = f"s{(k * 7919) % 700}", "ab"[k % 2]
        lines.append(f"{sid},1,{bundle},md,{k}.5,30,1,2,HC")
        first.setdefault((sid, bundle), k + 0.5)
    (tmp_path / "in.csv").write_text("sid,site,bundle,metric,mean,age,sex,handedness,disease\n" + "\n".join(lines) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = observations.load_results(spark, f"file://{tmp_path}/in.csv", order="_place")
        assert observations.scan_csv(spark, f"file://{tmp_path}/in.csv").rdd.getNumPartitions() > 10
        assert {(r["sid"], r["bundle"]): r["mean"] for r in rows.collect()} == first
        params = rows.select("bundle").distinct()
        result = sinks.harmonized_result(rows, params, method="m", model="x.model.csv", order="_place")
        sinks.write_harmonized(result, f"file://{tmp_path}/out", order="_place")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    out = spark.read.option("header", True).csv(f"file://{tmp_path}/out")
    written = [line for part in sorted((tmp_path / "out").glob("part-*")) for line in __import__("gzip").open(part, "rt").read().splitlines()[1:]]
    want = [(s, b, v) for (s, b), v in sorted(first.items(), key=lambda x: (x[0][1], x[1]))]
    assert [(x.split(",")[0], x.split(",")[1], float(x.split(",")[3])) for x in written] == want and "_place" not in out.columns


def test_drift_of_a_stream_is_the_batch_distance(spark, rows, tmp_path):
    ref = filters.controls(cohort.reference(rows))
    sent = rows.where(F.col("site").isin(cohort.MOVING, "ASIA")).withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    sent.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = drift(ref, spark.readStream.option("maxFilesPerTrigger", 1).schema(sent.schema).parquet(f"{tmp_path}/in"), Covariates(2))
    stream.writeStream.format("memory").queryName("drift").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination(120)
    got = {(r["site"], r["bundle"]): r["distance"] for r in spark.table("drift").collect()}
    for site in (cohort.MOVING, "ASIA"):
        for r in quality.distances(ref, rows.where(F.col("site") == site), Covariates(2)).collect():
            assert got[site, r["bundle"]] == pytest.approx(r["distance"], rel=1e-6)


def test_named_plots(spark):
    """Names and groups of any text survive; the last table's plot wins."""
    p = "bundle string, metric string, plot_group string, plot_name string, plot string"
    text = '{"plot_class":"line","data_x":[1,2],"data_y":[0.5,null],"x_label":"a \\"b\\""}'
    old = spark.createDataFrame([("a", "m", None, 'n "1"', text), ("a", "m", "g", "p", text), ("a", "m", "g", "q", text)], p)
    new = spark.createDataFrame([("a", "m", "g", "p", '{"plot_class":"bar"}'), ("b", "m", "ü\\", "p", text)], p)
    both = sinks.merge_named_plots(old, new)
    assert sorted(map(str, sinks.read_plot_documents(sinks.plot_documents(both)).collect())) == sorted(map(str, both.collect()))
    doc = __import__("json").loads({r["bundle"]: r["document"] for r in sinks.plot_documents(both).collect()}["a"])
    assert doc["g"]["p"] == {"plot_class": "bar"} and doc['n "1"']["x_label"] == 'a "b"' and set(doc) == {"g", 'n "1"'}
