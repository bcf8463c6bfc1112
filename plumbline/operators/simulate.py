"""A simulated site: biased values, and samples of subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .regression import Covariates, dot, fit, names_of, with_design


def hashed(sid: Column) -> Column:
    """An order of numeric ids that looks random and is the same everywhere."""
    return F.pmod(sid.try_cast("long") * F.lit(2654435761), F.lit(4294967296))


def sample_subjects(df: DataFrame, most: int) -> DataFrame:
    """All rows of at most ``most`` subjects of each site.  Subjects, not rows, are ranked."""
    first = Window.partitionBy("site").orderBy(hashed(F.col("sid")), "sid")
    keep = df.select("site", "sid").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).select("site", "sid")
    return df.join(keep, ["site", "sid"], "left_semi")


def corrupt(df: DataFrame, cov: Covariates, *, mult: float, add: float, slope: float, site: str | None = None, most: int | None = None) -> DataFrame:
    """Values with the spread, the level and the covariates' effect scaled (per cent) about a regression of all rows."""
    names = names_of(cov)
    rows = with_design(sample_subjects(df, most) if most else df, cov).join(fit(df, cov).drop("n"), "bundle")
    effect = dot([F.col(f"x{k}") for k in range(1, cov.size)], [F.col(c) for c in names[1:]]) if cov.size > 1 else F.lit(0.0)
    level = F.col(names[0])
    value = (F.col("mean") - level - effect) * mult / 100 + level * add / 100 + effect * slope / 100
    name = F.lit(site) if site else F.concat("site", F.lit("_corrupted"))
    put = {"mean": value, "site": name}
    return rows.select(*[put[c].alias(c) if c in put else F.col(c) for c in df.columns])
