"""Age windows and the curves drawn from them.

A centre is a whole year, so how far a window must be widened to hold an age depends on
two whole numbers only, the years half a width below and above it.  Windows are chosen on
the counts per such pair: about two a year, however many rows and real-valued ages there
are.  Rows are then joined once to the windows that hold their pair, never to all centres.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import settled
from .quantiles import percentiles, wide
from .simulate import hashed

STATIC, DYNAMIC, NOT_DYNAMIC = "static", "dynamic", "not_dynamic"
MOST_STEPS = 50
#: A share of a value under which sums of the same numbers in another order differ.
LAST_BITS = 2.0**-46


def _years(width: float) -> dict[str, Column]:
    """``_up`` and ``_dn``: the first centre not above, the last not below an age's half width."""
    age = F.col("age").cast("double")
    return {"_up": F.ceil(age - width / 2).cast("int"), "_dn": F.floor(age + width / 2).cast("int")}


def cells(df: DataFrame, *, width: float = 5, by: Sequence[str] = ("bundle",)) -> DataFrame:
    """(group..., _up, _dn, n, ages, values' number, mean and sum of squares): a row a pair of years."""
    rows = df.where(F.col("age").isNotNull()).withColumns(_years(width))
    return rows.groupBy(*by, "_up", "_dn").agg(F.count("*").alias("n"), F.min("age").alias("least_age"), F.max("age").alias("greatest_age"),
                                              F.count("mean").alias("values"), F.avg("mean").alias("centre_of"), (F.var_pop("mean") * F.count("mean")).alias("squares"))


def window_years(df: DataFrame, *, width: float = 5, least: int = 10, mode: str = DYNAMIC, by: Sequence[str] = ("bundle",)) -> DataFrame:
    """(group..., _up, _dn, centre, widened): the pairs of years in each centre's window."""
    return spans(cells(df, width=width, by=by), least=least, mode=mode, by=by)


def spans(counts: DataFrame, *, least: int = 10, mode: str = DYNAMIC, by: Sequence[str] = ("bundle",)) -> DataFrame:
    """``window_years`` of ``cells``.

    Centres are whole years from the least age up to, not with, the greatest.  A window
    of more rows than ``least`` stays; one of exactly ``least`` is left out; one of fewer
    is widened a year each way, at most 50 times, until it has them.  ``not_dynamic``
    never widens; ``static`` keeps every centre as it is.
    """
    by = list(by)
    bounds = counts.groupBy(*by).agg(F.min("least_age").cast("int").alias("lo"), F.max("greatest_age").cast("int").alias("hi")).where(F.col("lo") < F.col("hi"))
    grid = counts.join(bounds, by).select(*by, "_up", "_dn", "n", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("centre"))
    grid = grid.withColumn("steps", F.greatest(F.lit(0), F.col("_up") - F.col("centre"), F.col("centre") - F.col("_dn")))
    if mode == STATIC:
        return grid.where(F.col("steps") == 0).select(*by, "_up", "_dn", "centre", F.lit(0).alias("widened"))
    so_far = F.sum("n").over(Window.partitionBy(*by, "centre").orderBy("steps").rangeBetween(Window.unboundedPreceding, 0))
    spec = grid.withColumn("so_far", so_far).groupBy(*by, "centre").agg(
        F.coalesce(F.sum(F.when(F.col("steps") == 0, F.col("n"))), F.lit(0)).alias("inside"), F.min(F.when(F.col("so_far") >= least, F.col("steps"))).alias("reach"))
    steps = F.least(F.lit(MOST_STEPS), F.coalesce("reach", F.lit(MOST_STEPS)))
    spec = spec.where(F.col("inside") != least).select(*by, "centre", (F.lit(0) if mode == NOT_DYNAMIC else F.when(F.col("inside") > least, 0).otherwise(steps)).alias("widened"))
    return grid.join(spec, [*by, "centre"]).where(F.col("steps") <= F.col("widened")).select(*by, "_up", "_dn", "centre", "widened")


def windows(df: DataFrame, *, width: float = 5, by: Sequence[str] = ("bundle",), **how) -> DataFrame:
    """Rows once for each window that holds them, with ``centre`` and ``widened``."""
    return df.withColumns(_years(width)).join(window_years(df, width=width, by=by, **how), [*by, "_up", "_dn"]).drop("_up", "_dn")


def _beside(c: str, share: float) -> Column:
    """A value moved up by a share of its size, or down if the share is negative."""
    return F.col(c) * F.when(F.col(c) < 0, 1 - share).otherwise(1 + share)


def trimmed(df: DataFrame, *, width: float = 5, least: int = 10, low: float = 0.05, high: float = 0.95, most: int | None = None, by: Sequence[str] = ("bundle",)) -> DataFrame:
    """Dynamic windows; of those that needed no widening, the rows strictly between two percentiles, at most ``most`` by hash of the subject.

    The rows are settled first: a percentile often is a row's own value, and sums computed
    anew, in another order, may differ from it in their last bits.  So may sums of equal
    rows: values that the last bits alone tell from a percentile count as equal to it.
    """
    df, key = settled(df), [*by, "centre"]
    years = window_years(df, width=width, least=least, by=by)
    cut = wide(window_percentiles(df, (low, high), width=width, least=least, by=by), key, {"_low": low, "_high": high})
    size = cells(df, width=width, by=by).join(years, [*by, "_up", "_dn"]).groupBy(*key).agg(F.sum("n").alias("_n"))
    w = df.withColumns(_years(width)).join(years, [*by, "_up", "_dn"]).drop("_up", "_dn")
    out = w.join(cut.join(size, key), key).where((F.col("_n") <= least) | (F.col("widened") > 0) | ((F.col("mean") > _beside("_low", LAST_BITS)) & (F.col("mean") < _beside("_high", -LAST_BITS))))
    if most is not None:
        first = Window.partitionBy(*key).orderBy(F.coalesce(hashed(F.col("sid")), F.xxhash64("sid")), "sid")
        out = out.withColumn("_r", F.row_number().over(first)).where((F.col("_r") <= most) | (F.col("widened") > 0)).drop("_r")
    return out.drop("_n", "_low", "_high")


def window_percentiles(df: DataFrame, wanted: Sequence[float], *, width: float = 5, by: Sequence[str] = ("bundle",), **how) -> DataFrame:
    """(group..., centre, percentile, value), interpolated between rows.  Only rows near a wanted rank meet their windows."""
    cell = [*by, "_up", "_dn"]
    rows = df.where(F.col("age").isNotNull()).withColumns(_years(width))
    return percentiles(rows, [*by, "centre"], wanted, groups=window_years(df, width=width, by=by, **how).select(*cell, "centre"), cell=cell)


def mean_curve(df: DataFrame, *, width: float = 5, by: Sequence[str] = ("bundle",), **how) -> DataFrame:
    """(group..., centre, n, average, deviation).  Windows add up the moments of their pairs of years, so no row meets a window."""
    key, of_years = [*by, "centre"], cells(df, width=width, by=by)
    each = of_years.join(spans(of_years, by=by, **how), [*by, "_up", "_dn"])
    whole = Window.partitionBy(*key)
    average = F.try_divide(F.sum(F.col("values") * F.col("centre_of")).over(whole), F.sum("values").over(whole))
    gap = F.col("centre_of") - F.col("average")
    m = each.withColumn("average", average).groupBy(*key, "average").agg(F.sum("n").alias("n"), F.sum("values").alias("values"), F.sum(F.col("squares") + F.col("values") * gap * gap).alias("squares"))
    return m.select(*key, "n", "average", F.when(F.col("values") > 1, F.sqrt(F.col("squares") / (F.col("values") - 1))).alias("deviation"))


def around_subjects(ref: DataFrame, subjects: DataFrame, *, width: float = 4, method: str = "mean", parts: int = 16) -> DataFrame:
    """(metric, age, average, variability) of the reference rows within half a width of each subject age.

    Ages are real numbers in buckets of ``width / parts``.  For the mean, a window is the
    upper part of its first bucket, the lower part of its last and the buckets between;
    the parts are running sums in the order of age, so the work is that of sorting the
    ages.  For the median, ages of near buckets are compared.
    """
    if method != "mean":
        return _around_medians(ref, subjects, width, method)
    half, fine = width / 2, float(width) / parts
    bucket = lambda c: F.floor(c / fine)
    origin = ref.groupBy("metric").agg(F.avg("mean").alias("_o"))  # sums about the common mean lose no digits
    y = F.col("mean") - F.col("_o")
    ages = ref.where(F.col("age").isNotNull() & F.col("mean").isNotNull()).join(origin, "metric").groupBy("metric", F.col("age").cast("double").alias("x")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    ages = ages.withColumn("b", bucket(F.col("x")))
    at = F.col("at").cast("double")
    want = subjects.select("metric", F.col("age").alias("at")).where(F.col("at").isNotNull()).distinct().withColumns({"lo": at - half, "hi": at + half}).withColumns({"bl": bucket(F.col("lo")), "bh": bucket(F.col("hi"))})
    sums = ("n", "s", "q")
    # the two ends of each window stand among the ages of their buckets
    none = [F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")]
    ends = want.select("metric", F.col("lo").alias("x"), F.col("bl").alias("b"), *none, "at", F.lit("lo").alias("end")).unionByName(want.select("metric", F.col("hi").alias("x"), F.col("bh").alias("b"), *none, "at", F.lit("hi").alias("end")))
    mixed = ages.select("metric", "x", "b", *sums, F.lit(None).cast(dict(subjects.dtypes)["age"]).alias("at"), F.lit(None).cast("string").alias("end")).unionByName(ends)
    here = Window.partitionBy("metric", "b")
    up, down = here.orderBy("x").rangeBetween(Window.unboundedPreceding, 0), here.orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, 0)
    parts_of = mixed.select("metric", "at", "end", *[F.sum(c).over(up).alias(f"u{c}") for c in sums], *[F.sum(c).over(down).alias(f"d{c}") for c in sums]).where("end IS NOT NULL")
    outer = parts_of.select("metric", "at", *[F.when(F.col("end") == "lo", F.col(f"d{c}")).otherwise(F.col(f"u{c}")).alias(c) for c in sums])
    whole = ages.groupBy("metric", "b").agg(*[F.sum(c).alias(c) for c in sums])
    inner = want.where(F.col("bh") > F.col("bl") + 1).select("metric", "at", F.explode(F.sequence(F.col("bl") + 1, F.col("bh") - 1)).alias("b")).join(whole, ["metric", "b"]).select("metric", "at", *sums)
    total = outer.unionByName(inner).groupBy("metric", "at").agg(*[F.sum(c).alias(c) for c in sums]).where("n > 0").join(origin, "metric")
    n = F.col("n")
    return total.select("metric", F.col("at").alias("age"), (F.col("_o") + F.col("s") / n).alias("average"), F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / n) / (n - 1))).alias("variability"))


def _around_medians(ref: DataFrame, subjects: DataFrame, width: float, method: str) -> DataFrame:
    """Ages meet through buckets of a width, so only near ages are compared, and rows join by their exact age."""
    bucket = F.floor(F.col("age") / float(width))
    want = subjects.select("metric", "age").distinct().select("metric", F.col("age").alias("at"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("b"))
    have = ref.select("metric", "age").distinct().withColumn("b", bucket)
    near = want.join(have, ["metric", "b"]).where(F.abs(F.col("age") - F.col("at")) <= width / 2).select("metric", "age", "at")
    rows = ref.select("metric", "age", "mean").join(near, ["metric", "age"])
    return spread(rows, ["metric", "at"], method).withColumnRenamed("at", "age")


def spread(rows: DataFrame, by: Sequence[str], method: str) -> DataFrame:
    """(group..., average, variability): mean and sample deviation, or median and median absolute deviation."""
    if method == "mean":
        return rows.groupBy(*by).agg(F.avg("mean").alias("average"), F.stddev_samp("mean").alias("variability"))
    if method != "median":
        raise ValueError("method: mean or median")
    middle = rows.groupBy(*by).agg(F.median("mean").alias("average"))
    return rows.join(middle, list(by)).groupBy(*by, "average").agg(F.median(F.abs(F.col("mean") - F.col("average"))).alias("variability"))
