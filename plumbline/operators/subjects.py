"""Harmonization of single subjects, and comparison of two harmonizations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import around_subjects, spread


def subject_spread(df: DataFrame, method: str = "mean") -> DataFrame:
    """(sid, metric, average, variability) over a subject's bundles."""
    return spread(df, ["sid", "metric"], method)


def harmonize_subjects(ref: DataFrame, mov: DataFrame, *, width: float = 4, method: str = "mean") -> DataFrame:
    """Moving rows scaled from their subject's spread over bundles to that of reference rows of about its age."""
    own = subject_spread(mov, method).withColumnsRenamed({"average": "_a", "variability": "_v"})
    target = around_subjects(ref, mov, width=width, method=method).withColumnsRenamed({"average": "_ta", "variability": "_tv"})
    value = (F.col("mean") - F.col("_a")) * F.try_divide(F.col("_tv"), F.col("_v")) + F.col("_ta")
    out = mov.join(own, ["sid", "metric"]).join(target, ["metric", "age"], "left")
    return out.select(*[value.alias("mean") if c == "mean" else F.col(c) for c in mov.columns if c != "harmonization"], F.lit("single_subject").alias("harmonization"))


def compare(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows with their difference to another harmonization's value; null for bundles that it lacks, gone where it has the bundle but not the subject."""
    key = ["sid", "site", "bundle", "metric"]
    theirs = other.select(*key, F.col("mean").alias("mean_ref_harmonized"), F.lit(True).alias("_found"))
    known = other.select("bundle", F.lit(True).alias("_bundle")).distinct()
    gap = F.col("mean") - F.col("mean_ref_harmonized")
    j = df.join(theirs, key, "left").join(known, "bundle", "left").where(F.col("_found") | F.col("_bundle").isNull())
    out = j.select(*df.columns, "mean_ref_harmonized", gap.alias("difference_harmonized"), F.abs(F.least(gap, F.lit(0.0))).alias("err_lower"), F.greatest(gap, F.lit(0.0)).alias("err_upper"))
    place = ["site", "bundle", "metric"]
    spread_of = out.groupBy(*place).agg(F.stddev_samp("difference_harmonized").alias("uncertainty"))
    return out.join(spread_of, place).select(*out.columns, "uncertainty")


def output(ref: DataFrame, mov: DataFrame, harmonized: DataFrame) -> DataFrame:
    """The table of a single-subject run: both sites as they are, the reference once more under the method's name, and the harmonized rows."""
    raw = lambda df: df if "harmonization" in df.columns else df.withColumn("harmonization", F.lit("raw"))
    parts = [raw(ref), raw(mov), ref.withColumn("harmonization", F.lit("single_subject")), harmonized]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def bundle_data(mov: DataFrame, method: str = "mean") -> DataFrame:
    """(sid, average, variability): what each subject is scaled from."""
    return subject_spread(mov, method).select("sid", "average", "variability")
