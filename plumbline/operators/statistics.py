"""Sufficient statistics of a fit: a row a group, which further rows merge into.

A group has its number of rows, the means of the covariates and of the value, and their
co-moments about the means.  Regressions, residual means and deviations all come from
these, so a fit reads its rows once, and a refit after new rows have arrived reads those
only.  Nothing is subtracted that was summed about another origin, so values far from
zero lose no digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regression import Covariates, nan_if_null, solve

KEYS = ("site", "metric", "bundle")
#: Merged by least and greatest value, and by sum.
_LEAST, _GREATEST = ("age_min", "hc_age_min", "fit_age_min", "sex_min", "handedness_min"), ("age_max", "hc_age_max", "fit_age_max", "sex_max", "handedness_max")
_SUMMED = ("n", "n_odd", "n_hc", "sex_bad", "handedness_bad")


def names(degree: int) -> list[str]:
    """Covariates, and the value last."""
    return [*Covariates(degree).labels, "y"]


def moment_columns(degree: int) -> list[str]:
    v = names(degree)
    return [f"m_{a}" for a in v] + [f"c_{a}_{b}" for i, a in enumerate(v) for b in v[i:]]


def statistics(df: DataFrame, degree: int, *, by: Sequence[str] = KEYS, fitted: Column | None = None) -> DataFrame:
    """A row a group: moments of the ``fitted`` rows, and what guards and tuning ask about.

    Rows whose value is null do not count; one that is not finite is counted as odd.
    ``years`` are the whole years beside the fitted rows' ages.
    """
    use = F.lit(True) if fitted is None else fitted
    hc, y = F.col("disease") == "HC", F.col("mean").cast("double")
    finite = y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    v = names(degree)
    x = dict(zip(v, [F.when(use & finite, c) for c in [*Covariates(degree).columns()[1:], y]], strict=True))
    age = F.when(use, F.col("age"))
    years = F.flatten(F.collect_set(F.when(age.isNotNull(), F.array(F.floor(age).cast("int"), F.ceil(age).cast("int")))))
    out = [F.count_if(use & finite).alias("n"), F.count_if(use & y.isNotNull() & ~finite).alias("n_odd"), F.count_if(hc).alias("n_hc"),
           *[F.avg(c).alias(f"m_{a}") for a, c in x.items()], *[(F.covar_pop(x[a], x[b]) * F.count_if(use & finite)).alias(f"c_{a}_{b}") for i, a in enumerate(v) for b in v[i:]]]
    for name, c in (("age", F.col("age")), ("hc_age", F.when(hc, F.col("age"))), ("fit_age", age), ("sex", F.when(hc, F.col("sex"))), ("handedness", F.when(hc, F.col("handedness")))):
        out += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    for c in ("sex", "handedness"):
        out.append(F.count_if(hc & F.coalesce(~F.col(c).isin(1, 2), F.lit(True))).alias(f"{c}_bad"))
    return df.groupBy(*by).agg(*out, F.array_sort(F.array_distinct(years)).alias("years"))


def merged(parts: DataFrame, degree: int, *, by: Sequence[str] = KEYS) -> DataFrame:
    """One row a group of rows of statistics: about the common mean, each part adds its co-moments and its own mean's distance."""
    by, v = list(by), names(degree)
    weight = F.col("n").cast("double")
    centre = parts.groupBy(*by).agg(*[F.try_divide(F.sum(weight * F.col(f"m_{a}")), F.sum(F.when(F.col(f"m_{a}").isNotNull(), weight))).alias(f"centre_{a}") for a in v])
    apart = {a: F.col(f"m_{a}") - F.col(f"centre_{a}") for a in v}
    joined = parts.join(centre, by)
    years = F.array_sort(F.array_distinct(F.flatten(F.collect_list("years"))))
    return joined.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in _SUMMED], *[F.first(f"centre_{a}", True).alias(f"m_{a}") for a in v],
        *[F.sum(F.col(f"c_{a}_{b}") + weight * apart[a] * apart[b]).alias(f"c_{a}_{b}") for i, a in enumerate(v) for b in v[i:]],
        *[F.min(c).alias(c) for c in _LEAST], *[F.max(c).alias(c) for c in _GREATEST], years.alias("years"))


def pooled(degree: int, one: str, two: str, out: str) -> dict[str, Column]:
    """Columns of the statistics, under the prefix ``out``, of the rows of two prefixes together."""
    v, n1, n2 = names(degree), F.col(f"{one}n").cast("double"), F.col(f"{two}n").cast("double")
    gap = {a: F.col(f"{two}m_{a}") - F.col(f"{one}m_{a}") for a in v}
    share = F.try_divide(n2, n1 + n2)
    made = {f"{out}n": F.col(f"{one}n") + F.col(f"{two}n"), f"{out}n_odd": F.col(f"{one}n_odd") + F.col(f"{two}n_odd")}
    made |= {f"{out}m_{a}": F.col(f"{one}m_{a}") + gap[a] * share for a in v}
    return made | {f"{out}c_{a}_{b}": F.col(f"{one}c_{a}_{b}") + F.col(f"{two}c_{a}_{b}") + gap[a] * gap[b] * n1 * share for i, a in enumerate(v) for b in v[i:]}


def coefficients(df: DataFrame, degree: int, *, stats: str, out: str, used: dict[str, Column], weight: Column | float = 0.0, prior: str | None = None) -> DataFrame:
    """``df`` with ``<out>intercept`` and ``<out>beta_...`` of the statistics of a prefix.

    A covariate that is not ``used`` has 0.  ``weight`` is a ridge on all but the
    intercept, towards the coefficients of the prefix ``prior`` if given.
    """
    from .regression import EPSILON

    x, weight = names(degree)[:-1], weight if isinstance(weight, Column) else F.lit(float(weight))
    c = lambda a, b: F.col(f"{stats}c_{a}_{b}")
    on = lambda a: used.get(a, F.lit(True))
    near = lambda a: (F.col(f"{prior}{a}") if prior else F.lit(0.0)) + F.lit(EPSILON)
    system = {}
    for i, a in enumerate(x):
        pull = weight * F.abs(F.try_divide(near("intercept"), near(a))) if prior else weight
        for j, b in enumerate(x[i:], i):
            value = c(a, b) + pull if i == j else c(a, b)
            system[f"a{i}_{j}"] = F.when(on(a) & on(b), value).otherwise(1.0 if i == j else 0.0)
        system[f"b{i}"] = F.when(on(a), c(a, "y") + pull * near(a)).otherwise(0.0)
    df = solve(df.withColumns(system), len(x), [f"{out}{a}" for a in x]) if x else df
    level = F.col(f"{stats}m_y")
    for a in x:
        level = level - F.col(f"{out}{a}") * F.col(f"{stats}m_{a}")
    return df.withColumn(f"{out}intercept", level)


def residual_mean(degree: int, stats: str, beta: str) -> Column:
    """Mean residual of the rows of a prefix about the coefficients of another; NaN if any value is not finite."""
    out = F.col(f"{stats}m_y") - F.col(f"{beta}intercept")
    for a in names(degree)[:-1]:
        out = out - F.col(f"{beta}{a}") * F.col(f"{stats}m_{a}")
    return F.when(F.col(f"{stats}n_odd") > 0, float("nan")).otherwise(out)


def residual_sd(degree: int, stats: str, beta: str) -> Column:
    """Sample deviation of those residuals about their mean; NaN for one row or none."""
    x = names(degree)[:-1]
    ss = F.col(f"{stats}c_y_y")
    for i, a in enumerate(x):
        rest = -2.0 * F.col(f"{stats}c_{a}_y") + F.col(f"{beta}{a}") * F.col(f"{stats}c_{a}_{a}")
        for b in x[i + 1 :]:
            rest = rest + 2.0 * F.col(f"{beta}{b}") * F.col(f"{stats}c_{a}_{b}")
        ss = ss + F.col(f"{beta}{a}") * rest
    sd = F.when(F.col(f"{stats}n") > 1, F.sqrt(F.greatest(ss, F.lit(0.0)) / (F.col(f"{stats}n") - 1)))
    return F.when(F.col(f"{stats}n_odd") > 0, float("nan")).otherwise(nan_if_null(sd))


def append(stats: DataFrame, path: str) -> None:
    """Adds an arrival's statistics to a stored table; what is there stays as it is."""
    stats.write.mode("append").parquet(path)


def stored(spark, path: str, degree: int, *, by: Sequence[str] = KEYS) -> DataFrame:
    """A stored table's statistics, a row a group: all arrivals merged."""
    return merged(spark.read.parquet(path), degree, by=by)
