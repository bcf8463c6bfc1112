"""Harmonization of streams: an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.models import Model, small
from ..operators.quality import gaussian_distance
from ..operators.regression import Covariates, fit, names_of, residuals, with_design


def apply_stream(model: Model, rows: DataFrame) -> DataFrame:
    """A stream of observations on the reference scale: a join to the static parameters, without state."""
    return model.apply(rows)


def running_moments(rows: DataFrame, *, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and deviation of each site and bundle in windows of event time."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), "site", "bundle").agg(F.count("*").alias("n"), F.avg("mean").alias("average"), F.stddev_pop("mean").alias("deviation"))


def drift(ref: DataFrame, rows: DataFrame, cov: Covariates, *, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, site, bundle, distance, n): how far each site's stream of controls is from the reference, per window of event time; ours, not asked for.

    The reference's regression and residual moments are settled once, a row a bundle.
    The state is what a site and bundle have sent in a window: a number, a mean and a
    deviation, whatever the rows; a window is closed when it is ``late``.
    """
    params = small(fit(ref, cov).drop("n"))
    own = residuals(with_design(ref, cov), params, names_of(cov)).groupBy("bundle").agg(F.avg("residual").alias("m_ref"), F.stddev_pop("residual").alias("s_ref"), F.count("residual").alias("n_ref"))
    fixed = small(params.join(own, "bundle"))
    theirs = residuals(with_design(rows.where("disease = 'HC'").withWatermark(time, late), cov), fixed, names_of(cov))
    m = theirs.groupBy(F.window(time, window), "site", "bundle", "m_ref", "s_ref", "n_ref").agg(F.count("residual").alias("n"), F.avg("residual").alias("m"), F.stddev_pop("residual").alias("s"))
    d = gaussian_distance(F.col("m_ref"), F.col("s_ref"), F.col("m"), F.col("s"))
    return m.select("window", "site", "bundle", F.when((F.col("n") > 1) & (F.col("n_ref") > 1), d).otherwise(float("nan")).alias("distance"), "n")
