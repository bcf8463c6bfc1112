"""Cohort summaries and the tables behind plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles, wide


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def ages_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min("age").alias("min_age"), F.max("age").alias("max_age"))


def first_bundle(df: DataFrame) -> DataFrame:
    """Rows of the first bundle and metric, of which a subject has one."""
    first = df.agg(F.min(F.struct("bundle", "metric")).alias("x")).first()["x"]
    return df.where((F.col("bundle") == first["bundle"]) & (F.col("metric") == first["metric"])) if first else df.limit(0)


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, subjects, those of the first bundle, bundles, sites, age range and mean age, in whole years."""
    year = F.col("age").cast("long")
    first = df.agg(F.min(F.struct("bundle", "metric")).alias("x")).first()["x"]
    mine = (F.col("bundle") == first["bundle"]) & (F.col("metric") == first["metric"]) if first else F.lit(False)
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("sid").alias("n_subjects"), F.count_if(mine).alias("n_first_bundle"), F.count_distinct("bundle").alias("n_bundles"), F.count_distinct("site").alias("n_sites"), F.count_distinct("disease").alias("n_diseases"),
                  F.min(year).alias("min_age"), F.max(year).alias("max_age"), F.round(F.avg(year), 2).alias("mean_age"))


def categories(df: DataFrame, columns: Sequence[str] = ("disease", "sex", "handedness")) -> DataFrame:
    """(category, level, n, min_age, max_age): every level of the table, with its subjects and ages in the first bundle."""
    first = first_bundle(df).select(*columns, "age").withColumn("mine", F.lit(True))
    rows = first.unionByName(df.select(*columns).distinct().withColumns({"age": F.lit(None).cast("double"), "mine": F.lit(False)}))
    each = rows.select("age", "mine", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("level")) for c in columns])).alias("x"))
    return each.groupBy("x.category", "x.level").agg(F.count_if("mine").alias("n"), F.min("age").alias("min_age"), F.max("age").alias("max_age"))


def sides_table(bundles: DataFrame) -> DataFrame:
    """(nth, left, right, bilateral): names of ``bundle`` and ``side`` listed side by side."""
    nth = bundles.select("bundle", "side", F.row_number().over(Window.partitionBy("side").orderBy("bundle")).alias("nth"))
    return nth.groupBy("nth").pivot("side", ["left", "right", "bilateral"]).agg(F.first("bundle"))


def histogram(df: DataFrame, *, bins: int = 20, hue: str = "site") -> DataFrame:
    """(hue, bin, n, percent): equal bins over all values; the greatest value is in the last bin."""
    lo, hi = df.agg(F.min("mean"), F.max("mean")).first()
    if lo is None:
        return df.select(hue, F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("percent")).limit(0)
    width = (hi - lo) / bins or 1.0
    n = df.where(F.col("mean").isNotNull()).groupBy(hue, F.least(F.floor((F.col("mean") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(hue)))


def box_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Quartiles, mean, and whiskers: the farthest values within 1.5 quartile ranges."""
    quartiles = wide(percentiles(df, by, (0.25, 0.5, 0.75)), by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = quartiles.join(df.groupBy(*by).agg(F.avg("mean").alias("average")), list(by))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when((F.col("mean") >= F.col("q1") - reach) & (F.col("mean") <= F.col("q3") + reach), F.col("mean"))
    return df.select(*by, "mean").join(q, list(by)).groupBy(*by, "q1", "median", "q3", "average").agg(F.min(inside).alias("low"), F.max(inside).alias("high"))


def limits(df: DataFrame, by: Sequence[str] = ("bundle",), margin: float = 0.05) -> DataFrame:
    """Value range with a margin, and the first and ninety-ninth percentile."""
    p = wide(percentiles(df, by, (0.01, 0.99)), by, {"p01": 0.01, "p99": 0.99})
    return df.groupBy(*by).agg((F.min("mean") * (1 - margin)).alias("low"), (F.max("mean") * (1 + margin)).alias("high")).join(p, list(by)).select(*by, "low", "high", "p01", "p99")


def density(df: DataFrame, *, cells: int = 20, bins: int = 100, by: Sequence[str] = ("bundle",)) -> DataFrame:
    """(group..., age, value, density): a Gaussian kernel density over a grid of each group's range; it integrates to 1 over the plane.

    The kernel's covariance is the rows' sample covariance times n to the power -1/3, the
    usual rule for two dimensions.  Rows are first counted in ``bins`` squared bins, so
    the kernel runs over bins, not rows.  A group whose points lie on a line has null.
    """
    by = list(by)
    df = df.where(F.col("age").isNotNull() & F.col("mean").isNotNull() & ~F.isnan("mean"))
    shape = df.groupBy(*by).agg(F.min("age").alias("a0"), F.max("age").alias("a1"), F.min("mean").alias("v0"), F.max("mean").alias("v1"), F.count("*").alias("total"),
                                F.var_samp("age").alias("aa"), F.covar_samp("age", "mean").alias("av"), F.var_samp("mean").alias("vv"))
    scale = F.pow(F.col("total").cast("double"), F.lit(-1.0 / 3))
    shape = shape.withColumns({c: F.col(c) * scale for c in ("aa", "av", "vv")}).withColumn("det", F.col("aa") * F.col("vv") - F.col("av") * F.col("av"))
    bin_of = lambda x, lo, hi: F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col(x) - F.col(lo)) * bins, F.col(hi) - F.col(lo)), F.lit(0.0)))).cast("int")
    at = lambda k, n, lo, hi: F.col(lo) + (F.col(k) + 0.5) * (F.col(hi) - F.col(lo)) / n
    filled = df.join(shape, by).groupBy(*by, *shape.columns[len(by):], bin_of("age", "a0", "a1").alias("i"), bin_of("mean", "v0", "v1").alias("j")).agg(F.count("*").alias("n"))
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    each = filled.withColumn("gi", axis()).withColumn("gj", axis()).withColumns({"age": at("gi", cells, "a0", "a1"), "value": at("gj", cells, "v0", "v1")})
    x, y = F.col("age") - at("i", bins, "a0", "a1"), F.col("value") - at("j", bins, "v0", "v1")
    power = F.try_divide(F.col("vv") * x * x - 2 * F.col("av") * x * y + F.col("aa") * y * y, 2 * F.col("det"))
    return each.groupBy(*by, "gi", "gj", "age", "value", "total", "det").agg(F.sum(F.col("n") * F.exp(-power)).alias("s")).select(
        *by, "age", "value", F.try_divide(F.col("s"), F.col("total") * 2 * math.pi * F.sqrt("det")).alias("density"))
