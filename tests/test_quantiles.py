"""Percentiles, windows and folds against plain computations over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import quantiles, tuning, windows
from plumbline.operators.regression import Covariates

WANTED = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)


def groups(r):
    wide = np.concatenate([r.normal(size=300), 10.0 ** r.uniform(-300, 300, 200), -(10.0 ** r.uniform(-5, 5, 100)), np.zeros(50)])
    return {"normal": r.normal(50, 10, 500), "near": 1e6 + r.normal(0, 1e-6, 400), "ties": r.integers(0, 4, 333).astype(float), "wide": wide, "one": np.asarray([3.5]), "two": np.asarray([-1.0, 2.0]),
            "same": np.full(1000, 7.25), "ends": np.asarray([-1.7976931348623157e308, 0.0, 5e-324, 1.7976931348623157e308])}


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_percentiles(spark, most):
    """Buckets that are split again and again, values of all sizes, many equal values."""
    data = groups(np.random.default_rng(1))
    df = spark.createDataFrame([(g, float(v)) for g, x in data.items() for v in x] + [("normal", None), ("none", None)], "g string, mean double").repartition(5)
    got = {(r["g"], r["percentile"]): r["value"] for r in quantiles.percentiles(df, ["g"], WANTED, most=most).collect()}
    assert len(got) == len(data) * len(WANTED)
    for g, x in data.items():
        ordered = sorted(x)
        for p in WANTED:
            at = p * (len(x) - 1)
            lo, hi = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert got[g, p] == pytest.approx(lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi, rel=1e-12)
    assert quantiles.percentiles(df.limit(0), ["g"], WANTED).count() == 0


def test_not_a_number_is_greatest(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, float("nan"), float("inf"), float("-inf"), 2.0)], "g string, mean double")
    got = [r["value"] for r in quantiles.percentiles(df, ["g"], (0.0, 0.25, 0.5, 0.75, 1.0), most=1).orderBy("percentile").collect()]
    assert got[:4] == [float("-inf"), 1.0, 2.0, float("inf")] and math.isnan(got[4])


@pytest.fixture(scope="module")
def people(spark):
    r = np.random.default_rng(6)
    rows = [(k, "b" if k % 3 else "c", float(r.uniform(20, 60)), float(1e5 + r.normal())) for k in range(400)] + [(900, "c", 30.0, None)]
    return spark.createDataFrame(rows, "sid int, bundle string, age double, mean double").cache()


@pytest.mark.parametrize("how", [{}, {"least": 25}, {"mode": windows.STATIC}, {"mode": windows.NOT_DYNAMIC, "least": 12}])
def test_curves_are_those_of_the_rows_in_the_windows(people, how):
    rows = windows.windows(people, width=3, **how)
    held = {}
    for r in rows.collect():
        held.setdefault((r["bundle"], r["centre"]), []).append(r["mean"])
    curve = {(r["bundle"], r["centre"]): r for r in windows.mean_curve(people, width=3, **how).collect()}
    assert curve.keys() == held.keys()
    for k, x in held.items():
        v = np.asarray([y for y in x if y is not None])
        assert curve[k]["n"] == len(x) and curve[k]["average"] == pytest.approx(v.mean(), rel=1e-12)
        assert curve[k]["deviation"] is None if len(v) < 2 else curve[k]["deviation"] == pytest.approx(v.std(ddof=1), rel=1e-6)
    for r in windows.window_percentiles(people, (0.1, 0.5), width=3, **how).collect():
        v = [y for y in held[r["bundle"], r["centre"]] if y is not None]
        assert r["value"] == pytest.approx(np.quantile(v, r["percentile"]), rel=1e-12)


def test_reference_rows_around_real_ages(spark):
    r = np.random.default_rng(8)
    ref = [(m, float(a), float(5e4 + r.normal())) for m in ("x", "y") for a in np.concatenate([r.uniform(0, 90, 300), [10.0, 12.0, 14.0, 16.0]])] + [("x", None, 1.0)]
    subjects = [("x", float(a)) for a in np.concatenate([r.uniform(-3, 95, 120), [12.0, 14.0, 200.0]])] + [("z", 5.0), ("x", None)]
    got = {(q["metric"], q["age"]): q for q in windows.around_subjects(spark.createDataFrame(ref, "metric string, age double, mean double"), spark.createDataFrame(subjects, "metric string, age double")).collect()}
    want = {}
    for m, at in subjects:
        near = [v for k, a, v in ref if at is not None and a is not None and k == m and at - 2 <= a <= at + 2]
        if near:
            want[m, at] = near
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k]["average"] == pytest.approx(np.mean(v), rel=1e-12) and (got[k]["variability"] is None if len(v) == 1 else got[k]["variability"] == pytest.approx(np.std(v, ddof=1), rel=1e-6))


def test_left_out_subjects_equal_refits(spark):
    """Each fold fitted anew, among them one that hardly has a second level, and one that has none."""
    r = np.random.default_rng(9)
    make = lambda n, shift, level: [(k, "b", float(level + shift + 0.2 * a + r.normal()), float(a), 2 if k < (40 if shift == 0 else 1) else 1, int(r.integers(1, 3))) for k, a in enumerate(r.uniform(20, 80, n))]
    schema = "sid int, bundle string, mean double, age double, sex int, handedness int"
    cov, ridges = Covariates(1), [0.0, 0.5, 40.0]
    for level in (0.0, 1e5):
        ref_rows, mov_rows = make(90, 0, level), make(40, 3, level)
        mov_rows += [(7, "b", level + 20.0, 44.0, 1, 2), (7, "b", level + 21.0, 33.0, 1, 1)]  # a subject of three rows
        got = {q["ridge"]: q["mse"] for q in tuning.leave_one_out(spark.createDataFrame(ref_rows, schema), spark.createDataFrame(mov_rows, schema), cov, ridges).collect()}
        x_of = lambda rows: np.asarray([[1.0, q[4] == 2, q[5] == 2, q[3]] for q in rows], float)
        prior = np.linalg.lstsq(x_of(ref_rows), np.asarray([q[2] for q in ref_rows]), rcond=None)[0] + 2.220446049250313e-16
        for ridge in ridges:
            errors = []
            for sid in sorted({q[0] for q in mov_rows}):
                rest, mine = [q for q in mov_rows if q[0] != sid], min((q for q in mov_rows if q[0] == sid), key=lambda q: q[3])
                x, y = x_of(rest), np.asarray([q[2] for q in rest])
                pull = np.diag([0.0, *(ridge * np.abs(prior[0] / prior[1:]))])
                a = x.T @ x + pull
                if np.linalg.matrix_rank(a) < 4:
                    continue  # the only subject of a level
                beta = np.linalg.solve(a, x.T @ y + pull @ prior)
                errors.append((mine[2] - np.asarray([1.0, 0.5, 0.5, mine[3]]) @ beta) ** 2)
            assert got[ridge] == pytest.approx(np.mean(errors), rel=1e-6)


@pytest.mark.parametrize("alike, inside", [(1, range(2, 19)), (3, range(3, 18))])
@pytest.mark.parametrize("level", [100.0, -1000.0])
def test_trimmed_rows_are_those_that_the_percentiles_are_of(spark, alike, inside, level):
    """Values that differ in their last bit each time they are computed, as sums do; both percentiles are a row's own value, or that of rows alike."""
    rows = [(k, f"b{b}", 30.0 + k % 3, level + 7.0 * (k // alike) + b) for b in range(20) for k in range(21)]
    last_bit = F.udf(lambda x: math.nextafter(x, random.choice((-1e9, x, 1e9))), "double").asNondeterministic()
    df = spark.createDataFrame(rows, "sid int, bundle string, age double, mean double").withColumn("mean", last_bit("mean"))
    got = windows.trimmed(df, width=4, least=12).groupBy("bundle", "centre").agg(F.sort_array(F.collect_list("sid")).alias("sids")).collect()
    assert {(r["bundle"], r["centre"]) for r in got} == {(f"b{b}", c) for b in range(20) for c in (30, 31)}
    assert all(r["sids"] == list(inside) for r in got)
