"""Location and scale effects of a site: empirical Bayes and shrinkage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regression import nan_if_null

TOLERANCE, MOST_STEPS = 1e-4, 1000


def priors(effects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hyper-parameters over a model's groups: mean and variance of gamma, inverse-gamma a and b of the squared deltas."""
    d2 = F.col("delta_hat") * F.col("delta_hat")
    m = effects.groupBy(*by).agg(F.avg("gamma_hat").alias("gamma_bar"), nan_if_null(F.var_samp("gamma_hat")).alias("tau2"), F.avg(d2).alias("m"), nan_if_null(F.var_samp(d2)).alias("v"))
    return m.select(*by, "gamma_bar", "tau2", nan_if_null(F.try_divide(2 * F.col("v") + F.col("m") * F.col("m"), F.col("v"))).alias("a"),
                    nan_if_null(F.try_divide(F.col("m") * F.col("v") + F.pow("m", F.lit(3)), F.col("v"))).alias("b"))


def _step(state: Column, gamma_bar: Column, tau2: Column, a: Column, b: Column) -> Column:
    def one(x: Column) -> Column:
        up = tau2 * x["n"]
        g = (up * x["g0"] + x["d"] * gamma_bar) / (up + x["d"])
        s = (x["n"] - 1) * x["d0"] + x["n"] * (x["g0"] - g) * (x["g0"] - g)
        d = (s / 2 + b) / (x["n"] / 2 + a - 1)
        change = F.greatest(F.try_divide(F.abs(g - x["g"]), x["g"]), F.try_divide(F.abs(d - x["d"]), x["d"]))
        return F.struct(x["bundle"].alias("bundle"), x["n"].alias("n"), x["g0"].alias("g0"), x["d0"].alias("d0"), g.alias("g"), d.alias("d"), change.alias("change"))

    return F.transform(state, one)


def empirical_bayes(effects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(model..., bundle, gamma_star, delta_star, converged) of (bundle, n, gamma_hat, delta_hat).

    Estimates of a model's bundles stop together, when the largest relative change is at
    most the tolerance.  The sum of squares about a new gamma comes from the moments, so
    no row is read again.  A model's bundles are one row: there are as many as regions
    of the brain, whatever the number of subjects.
    """
    x = F.struct("bundle", F.col("n").cast("double").alias("n"), F.col("gamma_hat").alias("g0"), (F.col("delta_hat") * F.col("delta_hat")).alias("d0"),
                 F.col("gamma_hat").alias("g"), (F.col("delta_hat") * F.col("delta_hat")).alias("d"), F.lit(float("inf")).alias("change"))
    state = effects.groupBy(*by).agg(F.sort_array(F.collect_list(x)).alias("state"))
    hyper = priors(effects, by)
    one = state.join(hyper, list(by)) if by else state.withColumn("_", F.lit(1)).join(hyper.withColumn("_", F.lit(1)), "_").drop("_")
    done = lambda s: F.array_max(F.transform(s, lambda y: F.when(F.isnan(y["change"]), 0.0).otherwise(y["change"]))) <= TOLERANCE
    last = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), F.col("state"), lambda s, _: F.when(done(s), s).otherwise(_step(s, F.col("gamma_bar"), F.col("tau2"), F.col("a"), F.col("b"))))
    return one.select(*by, F.explode(last).alias("x"), done(last).alias("converged")).select(*by, "x.bundle", F.col("x.g").alias("gamma_star"), F.sqrt("x.d").alias("delta_star"), "converged")


def shrunk(delta: Column, n: Column, nu: float) -> Column:
    """A scale pulled towards 1 with the weight of ``nu`` rows."""
    return (delta * n + F.lit(float(nu))) / (n + F.lit(float(nu)))
