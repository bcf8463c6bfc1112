"""Whole runs: fit, apply and check in one session, and the tables behind the views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, quality, windows
from ..operators.models import Model, Options, fit_model, kept, small
from ..operators.quantiles import percentiles, wide
from ..sources import sinks


def fit_apply_check(ref: DataFrame, mov: DataFrame, *, method: str = "clinical", options: Options = Options(), degree_check: int = 0, ignore: Sequence[str] = filters.VENTRICLES) -> dict[str, DataFrame | Model]:
    """A fitted model, all moving rows harmonized, and distances to the reference before and after.

    ``model``, ``harmonized`` (the result columns), ``model_view``, ``curve_view``,
    ``raw_distances`` and ``harmonized_distances``.  All diseases are harmonized; controls are compared.
    Both tables are read many times: ``settled`` ones are not computed anew each time.
    """
    ref, mov = filters.ignore_bundles(ref, ignore), filters.ignore_bundles(mov, ignore)
    model = fit_model(method, ref, mov, options)
    name = f"{model.meta['mov_site']}-{model.meta['ref_site']}.{model.meta['metric_name']}.{method}.model.csv"
    result = sinks.harmonized_result(model.apply(mov), model.params, method=method, model=name)
    raw = lambda df: df.withColumns({"harmonization": F.lit("raw"), "model": F.lit("raw")})
    moved = raw(mov).unionByName(result.select(*mov.columns, "harmonization", "model"))
    return {
        "model": model, "harmonized": result, "model_view": model_view(model, ref, mov), "curve_view": curve_view(raw(ref), moved),
        "raw_distances": quality.check(model, ref, mov, degree_check), "harmonized_distances": quality.check(model, ref, result, degree_check),
    }


def data_view(df: DataFrame, *, dataset: str = "input", bundles: Sequence[str] | None = None, margin: float = 0.05) -> DataFrame:
    """(bundle, dataset, disease, sid, age, mean, low, high): the points of a scatter view and the value limits of the controls."""
    df = filters.require_single(df if bundles is None else df.where(F.col("bundle").isin(list(bundles))), "metric")
    lo, hi = F.min("mean"), F.max("mean")
    limits = filters.controls(df).groupBy("bundle").agg((lo - lo * margin).alias("low"), (hi + hi * margin).alias("high"))
    return df.select("bundle", F.col(dataset).alias("dataset"), "disease", "sid", "age", "mean").join(limits, "bundle")


def model_view(model: Model, ref: DataFrame, mov: DataFrame) -> DataFrame:
    """(bundle, layer, site, age, value): both sites' regression lines at every year of the controls' ages, and all rows as points."""
    both = ref.select("bundle", "site", "age", "mean", "disease").unionByName(mov.select("bundle", "site", "age", "mean", "disease"))
    span = filters.controls(both).groupBy("bundle").agg(F.min("age").alias("lo"), F.max("age").alias("hi")).where(F.col("lo") < F.col("hi"))
    grid = span.select("bundle", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("hi") - F.col("lo")).cast("int") - 1), lambda k: F.col("lo") + k)).alias("age"))
    line = lambda layer, site, moving: model.curve_at(grid, moving=moving).select("bundle", F.lit(layer).alias("layer"), F.lit(site).alias("site"), "age", "value")
    points = both.join(model.params.select("bundle"), "bundle", "left_semi").select("bundle", F.when(F.col("disease") == "HC", "control").otherwise("patient").alias("layer"), "site", "age", F.col("mean").alias("value"))
    return line("reference_line", model.meta.get("ref_site"), False).unionByName(line("moving_line", model.meta.get("mov_site"), True)).unionByName(points)


def curve_view(ref: DataFrame, moved: DataFrame, *, percentiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), width: float = 5, least: int = 10, min_subjects: int = 10) -> DataFrame:
    """(bundle, harmonization, model, curve, centre, percentile, value): percentile curves of the controls over age.

    ``moved`` has ``harmonization`` and ``model``; each of their combinations that has
    rows is a view of its own, with the raw reference beside it.  Sites with fewer raw
    controls than ``min_subjects`` in the first bundle stay out.
    """
    filters.require_single(ref.select("metric").unionByName(moved.select("metric")), "metric")
    hc = filters.controls(moved)
    first = ref.agg(F.min("bundle").alias("b"), F.min("metric").alias("m")).first()
    both = ref.unionByName(moved.select(*ref.columns))
    sites = filters.require_sites(filters.valid_sites(both, least=min_subjects, metric=first["m"], bundle=first["b"])).select("site")
    hc, raw = hc.join(sites, "site", "left_semi"), filters.controls(ref).join(sites, "site", "left_semi")
    by = ("bundle", "harmonization", "model")
    one = windows.window_percentiles(raw, percentiles, width=width, least=least).withColumn("curve", F.lit("reference"))
    theirs = windows.window_percentiles(hc, percentiles, width=width, least=least, by=by)
    theirs = theirs.withColumn("curve", F.when(F.col("harmonization") == "raw", "moving_raw").otherwise("moving_harmonized"))
    return one.join(hc.select(*by).distinct(), "bundle").unionByName(theirs)


def value_limits(ref: DataFrame, *, low: float = 0.01, high: float = 0.99, increase: float = 0.0, fixed: tuple[float, float] | None = None) -> DataFrame:
    """(bundle, low, high): two percentiles of the reference's values, moved out by a share of its least and greatest value (``increase``: per cent more); or fixed ones."""
    if fixed:
        return ref.select("bundle").distinct().withColumns({"low": F.lit(float(fixed[0])), "high": F.lit(float(fixed[1]))})
    share = 0.05 + increase / 100
    ends = wide(percentiles(ref, ["bundle"], (low, high)), ["bundle"], {"_p": low, "_q": high})
    return ref.groupBy("bundle").agg(F.min("mean").alias("_lo"), F.max("mean").alias("_hi")).join(ends, "bundle").select("bundle", (F.col("_p") - F.col("_lo") * share).alias("low"), (F.col("_q") + F.col("_hi") * share).alias("high"))


def curve_layers(ref: DataFrame, moved: DataFrame, *, lower: str | None = None, upper: str | None = None, limits: dict | None = None, **how) -> DataFrame:
    """(bundle, harmonization, model, layer, percentile, sid, x, y, low, high): all that a view over age is drawn from.

    ``percentiles`` are those of ``curve_view``, by curve; ``<curve>_band`` is a mean with
    a deviation to each side; ``subject`` is a moving row with its error bar, from the
    columns ``lower`` and ``upper`` (none: no bar); ``limits`` is the range of values.
    """
    by = ["bundle", "harmonization", "model"]
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda df, layer, x, y, low, high, percentile=None, sid=None: df.select(*by, layer.alias("layer"), (percentile if percentile is not None else none("double")).alias("percentile"), (sid if sid is not None else none("string")).alias("sid"), x.cast("double").alias("x"), y.alias("y"), low.alias("low"), high.alias("high"))
    nothing, windows_of = none("double"), {k: v for k, v in how.items() if k in ("width", "least")}
    band = lambda df, name: shape(df, F.lit(name), F.col("centre"), F.col("average"), F.col("average") - F.col("deviation"), F.col("average") + F.col("deviation"))
    with kept(ref) as r, kept(moved) as m:  # all but the points are a few rows a bundle and year, settled now
        views = small(m.select(*by).distinct())
        curves = small(curve_view(r, m, **how))
        theirs = small(windows.mean_curve(filters.controls(m), by=by, **windows_of))
        own = small(windows.mean_curve(filters.controls(r), **windows_of)).join(views, "bundle")
        edges = small(value_limits(r, **(limits or {}))).join(views, "bundle")
    bar = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c else F.lit(0.0)
    points = shape(moved, F.lit("subject"), F.col("age"), F.col("mean"), F.col("mean") - bar(lower), F.col("mean") + bar(upper), sid=F.col("sid").cast("string"))
    out = shape(curves, F.col("curve"), F.col("centre"), F.col("value"), nothing, nothing, F.col("percentile"))
    out = out.unionByName(band(own, "reference_band")).unionByName(band(theirs, "moving_band")).unionByName(points)
    return out.unionByName(shape(edges, F.lit("limits"), nothing, nothing, F.col("low"), F.col("high")))
