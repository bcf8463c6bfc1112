"""Statistics that merge, and the fits of many sites that they allow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import filters, statistics
from plumbline.operators.models import Options, fit_model, fit_sites, fit_statistics
from plumbline.operators.regression import Covariates, names_of

SCHEMA = "sid long, site string, bundle string, metric string, mean double, age double, sex int, handedness int, disease string"


@pytest.fixture(scope="module")
def rows(spark):
    """Three moving sites, two metrics, values far from zero; one site of one sex, one without a bundle."""
    r = np.random.default_rng(4)
    out, sid = [], 0
    for site, shift, scale in (("ref", 0, 1), ("m1", 3, 2), ("m2", -2, 0.5), ("m3", 1, 1.3)):
        for _ in range(60):
            sid += 1
            age, sex, hand = float(r.uniform(20, 80)), 1 if site == "m2" else int(r.integers(1, 3)), int(r.integers(1, 3))
            for bundle in ("a", "b", "c"):
                for metric, level in (("md", 1e6), ("fa", 0.5)):
                    if (site, bundle) != ("m3", "c"):
                        value = level + shift + 0.1 * age + 0.5 * sex + scale * r.normal()
                        out.append((sid, site, bundle, metric, value, age, sex, hand, "HC" if r.random() < 0.8 else "PT"))
    return spark.createDataFrame(out, SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("method", ["pairwise", "clinical"])
@pytest.mark.parametrize("options", [Options(), Options(limit_age=True, ref_controls_only=True, ridge=0.3, ridge_mov=0.7)])
def test_many_sites_as_one_by_one(rows, method, options):
    ref, mov = rows.where("site = 'ref'"), rows.where("site <> 'ref'")
    many = fit_sites(method, ref, mov, options)
    got = {(r["site"], r["metric"], r["bundle"]): r for r in many.params.collect()}
    assert len(got) == 16 and not any(k[0] == "m3" and k[2] == "c" for k in got)
    for site, metric in (("m1", "md"), ("m2", "fa"), ("m3", "md")):
        one = fit_model(method, ref.where(F.col("metric") == metric), mov.where((F.col("site") == site) & (F.col("metric") == metric)), options)
        assert one.cov.sex == (site != "m2")
        for r in one.params.collect():
            theirs = got[site, metric, r["bundle"]]
            assert all(theirs[c] == pytest.approx(r[c], rel=1e-9, abs=1e-12) for c in one.params.columns if c != "bundle")
            assert one.cov.sex or all(theirs[c] == 0 for c in many.params.columns if c.endswith("beta_sex"))
    applied = many.apply(mov)
    assert applied.count() == mov.count() and applied.columns == mov.columns


def test_against_least_squares(rows):
    """Coefficients and deviations of values a million from zero."""
    ref, mov = rows.where("site = 'ref' AND metric = 'md'"), rows.where("site = 'm1' AND metric = 'md'")
    p = {r["bundle"]: r for r in fit_model("pairwise", ref, mov, Options(bayes=False)).params.collect()}
    both = ref.unionByName(filters.controls(mov)).toPandas()
    for bundle, d in both.groupby("bundle"):
        x = np.column_stack([np.ones(len(d)), d.sex == 2, d.handedness == 2, d.age]).astype(float)
        beta, *_ = np.linalg.lstsq(x, d["mean"].to_numpy(), rcond=None)
        res = d["mean"].to_numpy() - x @ beta
        assert np.allclose([p[bundle][c] for c in names_of(Covariates(1))], beta, rtol=1e-8) and p[bundle]["sigma"] == pytest.approx(res.std(ddof=1), rel=1e-7)
        assert p[bundle]["ref_gamma"] == pytest.approx(res[d.site == "ref"].mean(), abs=1e-6) and p[bundle]["mov_delta"] == pytest.approx(res[d.site == "m1"].std(ddof=1) / res.std(ddof=1), rel=1e-7)


def test_arrivals_are_merged(spark, rows, tmp_path):
    """Arrivals that are stored one after the other give the fit of all rows; the last one alone is read for it."""
    fitted, path = (F.col("site") == "ref") | (F.col("disease") == "HC"), f"file://{tmp_path}/stats"
    for k in range(5):
        statistics.append(statistics.statistics(rows.where(F.col("sid") % 5 == k), 2, fitted=fitted), path)
    whole, parts = statistics.statistics(rows, 2, fitted=fitted), statistics.stored(spark, path, 2)
    a, b = ({tuple(r[c] for c in statistics.KEYS): r for r in x.collect()} for x in (whole, parts))
    assert a.keys() == b.keys()
    for k, r in a.items():
        for c in whole.columns:
            assert b[k][c] == (pytest.approx(r[c], rel=1e-9, abs=1e-6) if isinstance(r[c], float) else r[c]), c
    for method in ("pairwise", "clinical"):
        m = fit_statistics(method, parts.where("site = 'ref'"), parts.where("site <> 'ref'"), 2, Options())
        again = fit_sites(method, rows.where("site = 'ref'"), rows.where("site <> 'ref'"), Options(degree=2))
        one, two = (sorted(x.params.select(*again.params.columns).collect()) for x in (m, again))
        assert len(one) == len(two) == 16 and all(u == pytest.approx(v, rel=1e-6, abs=1e-9) if isinstance(v, float) else u == v for x, y in zip(one, two) for u, v in zip(x, y))


def test_guards_and_odd_values(spark, rows):
    ref, mov = rows.where("site = 'ref'"), rows.where("site <> 'ref'")
    for wrong, why in (((rows, mov), "one site"), ((ref, mov.withColumn("bundle", F.lit("z"))), "in common"), ((ref, mov.withColumn("sex", F.lit(3))), "sex"), ((ref, mov.limit(0)), "no moving"), ((ref.limit(0), mov), "one site")):
        with pytest.raises(ValueError, match=why):
            fit_sites("pairwise", *wrong)
    with pytest.raises(ValueError, match="unknown"):
        fit_sites("other", ref, mov)
    one = mov.where("site = 'm1' AND metric = 'md'")
    odd = one.withColumn("mean", F.when((F.col("bundle") == "a") & (F.col("sid") % 7 == 0), float("nan")).when((F.col("bundle") == "b") & (F.col("sid") % 7 == 0), F.lit(None)).otherwise(F.col("mean")))
    p = {r["bundle"]: r for r in fit_model("pairwise", ref.where("metric = 'md'"), odd, Options(bayes=False)).params.collect()}
    assert math.isnan(p["a"]["sigma"]) and math.isnan(p["a"]["mov_gamma"]) and not math.isnan(p["a"]["ref_gamma"]) and p["b"]["sigma"] > 0
    alone = statistics.statistics(ref.limit(1), 1).first()
    assert alone["n"] == 1 and alone["c_y_y"] == 0 and statistics.statistics(ref.limit(0), 1).count() == 0
