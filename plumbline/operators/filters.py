"""Projections, filters and checks on observation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VENTRICLES = ("left_ventricle", "right_ventricle")


def predicate(*, age: tuple[float, float] | None = None, **equal: Any) -> Column:
    """AND of one test a column: a value for equality, a list for membership, None for no test; ``age`` is an inclusive range."""
    out = F.lit(True)
    for column, want in equal.items():
        if want is not None:
            out &= F.col(column).isin(list(want)) if isinstance(want, (list, tuple, set)) else F.col(column) == want
    return out if age is None else out & F.col("age").between(*age)


def controls(df: DataFrame) -> DataFrame:
    return df.where(F.col("disease") == "HC")


def ignore_bundles(df: DataFrame, names: Sequence[str] = VENTRICLES) -> DataFrame:
    return df.where(~F.col("bundle").isin(list(names))) if names else df


def limit_age_range(ref: DataFrame, mov: DataFrame) -> DataFrame:
    """Reference rows within the moving site's ages; the range is one row, whatever the tables' sizes."""
    lo, hi = mov.agg(F.min("age"), F.max("age")).first()
    return ref.where(F.col("age").between(lo, hi)) if lo is not None else ref.limit(0)


def common_bundles(ref: DataFrame, mov: DataFrame) -> DataFrame:
    return ref.select("bundle").intersect(mov.select("bundle"))


def covariate_levels(df: DataFrame) -> DataFrame:
    """For each bundle and covariate, its distinct levels and how many values are neither 1 nor 2."""
    each = df.select("bundle", F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).alias("level")) for c in ("sex", "handedness")])).alias("x")).select("bundle", "x.*")
    invalid = F.count_if(F.coalesce(~F.col("level").isin(1, 2), F.lit(True)))
    return each.groupBy("bundle", "covariate").agg(F.count_distinct("level").alias("n_levels"), invalid.alias("n_invalid"))


def usable_covariates(*tables: DataFrame) -> dict[str, bool]:
    """Whether each covariate can be fitted: not if any bundle of any table has one level only.  An invalid value is an error."""
    out = {"sex": True, "handedness": True}
    for t in tables:
        for r in covariate_levels(controls(t)).groupBy("covariate").agg(F.min("n_levels").alias("least"), F.sum("n_invalid").alias("bad")).collect():
            if r["bad"]:
                raise ValueError(f"{r['covariate']} has values other than 1 and 2")
            out[r["covariate"]] &= r["least"] > 1
    return out


def site_metric_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("site").alias("n_sites"), F.count_distinct("metric").alias("n_metrics"), F.count_distinct("sid").alias("n_subjects"))


def require_single(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` if each column has one value, else an error."""
    counts = df.agg(*[F.count_distinct(c) for c in columns]).first()
    if wrong := [c for c, n in zip(columns, counts, strict=True) if n != 1]:
        raise ValueError(f"one value expected in: {', '.join(wrong)}")
    return df


def valid_sites(df: DataFrame, *, least: int, metric: str, bundle: str) -> DataFrame:
    """Sites with at least ``least`` raw control rows of a metric and bundle; see ``require_sites``."""
    where = (F.col("disease") == "HC") & (F.col("metric") == metric) & (F.col("bundle") == bundle)
    if "harmonization" in df.columns:
        where &= F.col("harmonization") == "raw"
    return df.where(where).groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def require_sites(sites: DataFrame) -> DataFrame:
    """``sites`` if there is one, else an error."""
    if sites.isEmpty():
        raise ValueError("no site has enough controls")
    return sites


def choose_bundles(available: Sequence[str], wanted: Sequence[str] | str | None = None) -> list[str]:
    """The wanted bundles that exist, else the first: by default the first whose name has ``skeleton``; ``all`` for all."""
    names = sorted(available)
    if wanted == "all" or (wanted and list(wanted) == ["all"]):
        return names
    some = [b for b in ([next((b for b in names if "skeleton" in b), "")] if wanted is None else wanted) if b in names]
    return some or names[:1]


def side(bundle: Column) -> Column:
    """left, right or bilateral, by the bundle's name."""
    return F.when(bundle.contains("_L") | bundle.contains("left_"), "left").when(bundle.contains("_R") | bundle.contains("right_"), "right").otherwise("bilateral")


def manufacturer(site: Column, *, reference: str | None = None, known: Mapping[str, str] | None = None) -> Column:
    """A site's scanner maker: as looked up, the reference by itself, else by the site's name."""
    low = F.lower(site)
    guess = F.when(low.contains("philips"), "Philips").when(low.contains("siemens"), "Siemens").when(low.contains("ge"), "GE").otherwise("unknown")
    if known:
        guess = F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[site], guess)
    return guess if reference is None else F.when(site == reference, "Reference").otherwise(guess)


def label_site(site: Column, *, reference: str | None = None, reference_name: str | None = None, known: Mapping[str, str] | None = None) -> Column:
    """A site's name without its maker: the reference as named, known sites without theirs, others in lower case without the one they hold."""
    low = F.lower(site)
    plain = lambda maker: F.replace(F.replace(low, F.lit(f"_{maker}"), F.lit("")), F.lit("3t"), F.lit("3T"))
    out = F.when(low.contains("philips"), plain("philips")).when(low.contains("siemens"), plain("siemens")).when(low.contains("ge"), plain("ge")).otherwise(site)
    if reference is not None:
        out = F.when(site == reference, F.lit(reference_name) if reference_name else site).otherwise(out)
    for name, maker in (known or {}).items():
        out = F.when(site == name, F.lit(reference_name or name.replace(f"_{maker}", ""))).otherwise(out)
    return out


def site_makers(metadata: DataFrame, reference: str) -> DataFrame:
    """(site, manufacturer) of a metadata table whose 14th column is the maker and whose 16th is the site; blank makers are unknown."""
    maker, site = F.col(f"`{metadata.columns[13]}`"), F.col(f"`{metadata.columns[15]}`")
    named = F.when(site == reference, "Reference").when(F.coalesce(maker, F.lit("")) == "", "unknown").otherwise(maker)
    return metadata.select(site.alias("site"), named.alias("manufacturer")).where(F.col("site").isNotNull()).groupBy("site").agg(F.max("manufacturer").alias("manufacturer"))
