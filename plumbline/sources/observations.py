"""Observation tables: schema, loading, normalising, deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "sid string, site string, bundle string, metric string, mean double, age double, sex int, handedness int, disease string"
REQUIRED = tuple(x.split()[0] for x in SCHEMA.split(", "))
#: What tells observations apart; the measured value does not.
KEYS = ("sid", "site", "bundle", "metric", "age", "sex", "handedness", "disease", "harmonization", "model")
RESULT = ("sid", "bundle", "metric", "mean", "site", "age", "sex", "handedness", "disease", "harmonization", "model")


def require(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    """``df`` if it has all columns, else an error that names those it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def scan_csv(spark: SparkSession, *paths: str, order: str | None = None) -> DataFrame:
    """Observations of CSV files (gzip by ending), typed where their names are known; other columns are strings.

    ``order`` names a column for the place in the file: where the row's split begins, and
    the row's rank among those of the split.  It holds however a file is split, and
    however splits are packed into tasks.
    """
    raw = spark.read.option("header", True).option("nanValue", "NaN").csv(list(paths))
    if order:
        raw = raw.select("*", F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth")).alias(order))
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    cast = {c: F.col(c).cast("double").cast("int") if k == "int" else F.col(c).cast(k) for c, k in kinds.items() if c in raw.columns}
    return require(raw.withColumns(cast))


def keep_first(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """One row for each combination of ``keys``, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")


def normalise(df: DataFrame, *, order: str | Column, source: Column | None = None) -> DataFrame:
    """Controls named ``HC``, sites as strings, default ``harmonization`` and ``model``; one row a key; no row with a null.

    Duplicates go before rows with nulls do, so a first row with a null removes its key.
    """
    pre = F.col("harmonization") if "harmonization" in df.columns else F.lit(None).cast("string")
    model = F.col("model") if "model" in df.columns else F.lit(None).cast("string")
    harmonization = F.when(F.lower(pre) == "pre", "raw").otherwise(pre if "harmonization" in df.columns else F.lit("raw"))
    out = require(df).withColumns({"disease": F.when(F.col("disease") == "NC", "HC").otherwise(F.col("disease")), "site": F.col("site").cast("string"), "harmonization": harmonization})
    out = out.withColumn("model", model if "model" in df.columns else F.col("harmonization"))
    if source is not None:
        out = out.withColumn("input", source)
    return keep_first(out, KEYS, order).dropna("any")


def _load(spark: SparkSession, path: str) -> DataFrame:
    rows = scan_csv(spark, path, order="_row")
    return normalise(rows, order="_row", source=F.element_at(F.split(F.input_file_name(), "/"), -1))


def load_results(spark: SparkSession, path: str, *, order: str | None = None) -> DataFrame:
    """A normalised CSV file with ``input``, its name; first means first in the file.  ``order`` names a column to keep for the place in it."""
    out = _load(spark, path)
    return out.withColumnRenamed("_row", order) if order else out.drop("_row")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A site-metadata CSV file, all columns as strings."""
    return spark.read.option("header", True).csv(path)


def union_sites(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, in columns by name; columns that a table lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def load_sites(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several normalised files; a key may come once from each file name, the first in the order of the paths."""
    both = union_sites(*[_load(spark, p).withColumn("_file", F.lit(k)) for k, p in enumerate(paths)])
    return keep_first(both, (*KEYS, "input"), F.struct("_file", "_row")).drop("_file", "_row")
