"""Distances between distributions and effect sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import controls
from .models import Model, kept, sides, small
from .regression import Covariates, fit, names_of, residuals, with_design


def gaussian_distance(m1: Column, s1: Column, m2: Column, s2: Column) -> Column:
    """Bhattacharyya distance of two normal distributions."""
    v = s1 * s1 + s2 * s2
    return F.try_divide((m1 - m2) * (m1 - m2), v) / 4 + F.log(F.try_divide(v, 2 * s1 * s2)) / 2


def distances(ref: DataFrame, mov: DataFrame, cov: Covariates) -> DataFrame:
    """(bundle, distance, n_hc): distance of the sites' controls about the reference's regression.

    Two passes over the held rows for all bundles.  NaN where a side has one row or none.
    """
    with kept(sides(controls(ref), controls(mov))) as both:
        params = small(fit(both.where("side = 'ref'"), cov).drop("n"))
        rows = residuals(with_design(both, cov), params, names_of(cov))
        at = lambda s: F.when(F.col("side") == s, F.col("residual"))
        m = small(rows.groupBy("bundle").agg(*[f(at(s)).alias(f"{n}_{s}") for s in ("ref", "mov") for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]))
    d = gaussian_distance(F.col("m_ref"), F.col("s_ref"), F.col("m_mov"), F.col("s_mov"))
    return m.select("bundle", F.when((F.col("n_ref") > 1) & (F.col("n_mov") > 1), d).otherwise(float("nan")).alias("distance"), F.col("n_mov").alias("n_hc"))


def check(model: Model, ref: DataFrame, mov: DataFrame, degree: int = 0) -> DataFrame:
    """Distances with the model's covariates, at its degree or another."""
    return distances(ref, mov, Covariates(degree or model.cov.degree, model.cov.sex, model.cov.handedness))


def summary(d: DataFrame) -> DataFrame:
    return d.where(~F.isnan("distance")).agg(F.count("*").alias("n_bundles"), F.avg("distance").alias("mean"), F.min("distance").alias("min"), F.max("distance").alias("max"))


def cohens_d(df: DataFrame, site1: str, site2: str) -> DataFrame:
    """One row a metric: difference of two sites over the spread of their subjects' averages; 0 if either has a subject or none.

    Under 50 subjects the estimate is corrected for the smaller group.
    """
    subjects = df.where(F.col("site").isin(site1, site2)).groupBy("metric", "site", "sid").agg(F.avg("mean").alias("x"))
    at = lambda s: F.when(F.col("site") == s, F.col("x"))
    m = subjects.groupBy("metric").agg(*[f(at(s)).alias(f"{n}{k}") for k, s in ((1, site1), (2, site2)) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))])
    n = F.least("n1", "n2").cast("double")
    d = F.try_divide(F.abs(F.col("m1") - F.col("m2")), F.sqrt((F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")) / 2))
    few = (n - 3) / (n - 2.25) * F.sqrt((n - 2) / n)
    return m.select("metric", F.when(n <= 1, 0.0).when((n > 2) & (n < 50), d * few).otherwise(d).alias("cohens_d"))


def window_effect(reference: DataFrame, site: DataFrame) -> DataFrame:
    """Errors and effect size of a site's age windows against the reference's of the same centre."""
    r = reference.select("bundle", "centre", F.col("average").alias("ra"), F.col("deviation").alias("rd"))
    pooled = F.sqrt((F.col("rd") * F.col("rd") + F.col("deviation") * F.col("deviation")) / 2)
    gap = F.col("ra") - F.col("average")
    return site.join(r, ["bundle", "centre"]).select("bundle", "centre", gap.alias("mean_error"), (F.col("rd") - F.col("deviation")).alias("std_error"), F.try_divide(gap, pooled).alias("effect_size"))


def subjects_checked(mov: DataFrame) -> int:
    """Distinct subjects among the moving controls, as the quality report counts them."""
    return controls(mov).agg(F.count_distinct("sid")).first()[0]
