"""Harmonization models: fitted, applied, drawn as curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.observations import require
from . import filters
from .regression import Covariates, dot, fit, gram, nan_if_null, names_of, residuals, solve, with_design, with_ridge
from .site_effect import empirical_bayes, shrunk
from .statistics import KEYS, coefficients, pooled, residual_mean, residual_sd, statistics


@dataclass(frozen=True)
class Options:
    """Settings of a fit."""

    degree: int | None = None
    sex: bool = True
    handedness: bool = True
    bayes: bool = True
    limit_age: bool = False
    ref_controls_only: bool = False
    ridge: float = 0.0
    ridge_ref: float = 0.0
    ridge_mov: float = -1.0
    nu: float = 5.0
    tau: float = 2.0

    def __post_init__(self):
        if (self.degree or 0) < 0 or self.ridge < 0 or self.ridge_ref < 0 or self.nu < 0 or self.tau < 1 or (self.ridge_mov < 0 and self.ridge_mov != -1):
            raise ValueError("degree, ridges and nu must not be negative (ridge_mov: -1 tunes it); tau must be at least 1")


@dataclass(frozen=True)
class Model:
    """A fitted model: one row of parameters a bundle, and what was fitted."""

    params: DataFrame
    cov: Covariates
    meta: Mapping[str, Any] = field(default_factory=dict)
    #: What tells parameters apart: with ``site`` and ``metric`` it holds the models of many.
    by: tuple[str, ...] = ("bundle",)

    def _rows(self, df: DataFrame) -> DataFrame:
        """Rows of the model's bundles with design and parameters; the parameters are a row a bundle."""
        return with_design(df, self.cov).join(self.params, list(self.by))

    def _line(self, prefix: str) -> Column:
        return dot([F.col(f"x{k}") for k in range(self.cov.size)], [F.col(c) for c in names_of(self.cov, prefix)])

    def curve(self, ages: Column, *, moving: bool = True) -> DataFrame:
        """(bundle, age, value) at the ages of an array column."""
        return self.curve_at(self.params.select(*self.by, F.explode(ages).alias("age")), moving=moving)

    def curve_at(self, grid: DataFrame, *, moving: bool = True) -> DataFrame:
        """(bundle, age, value) at the (bundle, age) of a table."""
        names = names_of(self.cov, self._prefix(moving))
        return grid.select(*self.by, "age").join(self.params.select(*self.by, *names), list(self.by)).select(*self.by, "age", dot(self.cov.at(F.col("age").cast("double")), [F.col(c) for c in names]).alias("value"))

    def _prefix(self, moving: bool) -> str:
        return ""

    def standardised(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _harmonized(self) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with ``mean`` on the reference site's scale; rows of bundles that the model lacks go.

        Nothing is shuffled but the parameters, so it also serves streams.
        """
        return self._rows(df).select(*[self._harmonized().alias("mean") if c == "mean" else F.col(c) for c in df.columns])


class Pairwise(Model):
    """One regression of both sites pooled; each site has a shift and a scale about it."""

    def standardised(self, df: DataFrame) -> DataFrame:
        return self._rows(df).select(*df.columns, ((F.col("mean") - self._line("")) / F.col("sigma")).alias("z"))

    def _harmonized(self) -> Column:
        line = self._line("")
        return F.col("ref_delta") / F.col("mov_delta") * (F.col("mean") - line - F.col("mov_gamma")) + F.col("ref_gamma") + line


class Clinical(Model):
    """A regression a site, the moving one drawn towards the reference; the moving scale is shrunk."""

    def _prefix(self, moving: bool) -> str:
        return "mov_" if moving else "ref_"

    def standardised(self, df: DataFrame) -> DataFrame:
        return self._rows(df).select(*df.columns, ((F.col("mean") - self._line("mov_")) / F.col("ref_std")).alias("z"))

    def _harmonized(self) -> Column:
        z = (F.col("mean") - self._line("mov_")) / F.col("ref_std")
        return F.col("ref_std") / F.col("mov_delta") * (z - F.col("mov_gamma")) + self._line("ref_")


def profile(ref: DataFrame, mov: DataFrame) -> list:
    """A row a side and bundle, from one job: rows, sites, metrics and ages, and of the controls their number, ages and levels."""
    cols = ["site", "metric", "bundle", "age", "sex", "handedness", "disease"]
    both = ref.select(*cols, F.lit("ref").alias("side")).unionByName(mov.select(*cols, F.lit("mov").alias("side")))
    hc = lambda c: F.when(F.col("disease") == "HC", F.col(c))
    out = [F.count_if(F.col("disease") == "HC").alias("n_hc"), F.min(hc("age")).alias("hc_age_min"), F.max(hc("age")).alias("hc_age_max")]
    for c in ("site", "metric", "age"):
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    for c in ("sex", "handedness"):
        out += [F.min(hc(c)).alias(f"{c}_min"), F.max(hc(c)).alias(f"{c}_max"), F.count_if((F.col("disease") == "HC") & F.coalesce(~F.col(c).isin(1, 2), F.lit(True))).alias(f"{c}_bad")]
    return both.groupBy("side", "bundle").agg(*out).collect()


@dataclass(frozen=True)
class Prepared:
    """Rows to fit on, the covariates that both sites allow, and what is fitted."""

    ref: DataFrame
    mov: DataFrame
    cov: Covariates
    meta: Mapping[str, Any]


def prepared(ref: DataFrame, mov: DataFrame, options: Options, degree: int) -> Prepared:
    """Controls only of the moving site; of the reference all rows, unless asked otherwise.

    An age limit is the range of all moving rows, patients too.  Each side must have one
    site, both one metric and some bundle in common; only common bundles are fitted.
    """
    require(ref)
    require(mov)
    rows = profile(ref, mov)
    one = lambda side, c: {x for r in rows if r["side"] == side for x in (r[f"{c}_min"], r[f"{c}_max"])}
    for side, name in (("ref", "reference"), ("mov", "moving")):
        if len(one(side, "site")) != 1:
            raise ValueError(f"the {name} rows must be of one site")
    if len(one("ref", "metric") | one("mov", "metric")) != 1:
        raise ValueError("both sides must have one and the same metric")
    ref = filters.controls(ref) if options.ref_controls_only else ref
    if options.limit_age:
        ages = [x for r in rows if r["side"] == "mov" for x in (r["age_min"], r["age_max"]) if x is not None]
        ref = ref.where(F.col("age").between(min(ages), max(ages))) if ages else ref.limit(0)
    if options.limit_age or options.ref_controls_only:
        rows = profile(ref, mov)
    bundles = sorted({r["bundle"] for r in rows if r["side"] == "ref"} & {r["bundle"] for r in rows if r["side"] == "mov" and r["n_hc"]})
    if not bundles:
        raise ValueError("the sites have no bundle in common")
    usable = {}
    for c in ("sex", "handedness"):
        if any(r[f"{c}_bad"] for r in rows):
            raise ValueError(f"{c} has values other than 1 and 2")
        usable[c] = not any(r["n_hc"] and r[f"{c}_min"] == r[f"{c}_max"] for r in rows)
    cov = Covariates(degree if options.degree is None else options.degree, options.sex, options.handedness).only(usable)
    ages = [x for r in rows if r["side"] == "mov" and r["n_hc"] for x in (r["hc_age_min"], r["hc_age_max"])]
    meta = {"ref_site": one("ref", "site").pop(), "mov_site": one("mov", "site").pop(), "metric_name": one("mov", "metric").pop(), "min_age": min(ages), "max_age": max(ages),
            "use_empirical_bayes": options.bayes, "limit_age_range": options.limit_age}
    return Prepared(ref.where(F.col("bundle").isin(bundles)), filters.controls(mov).where(F.col("bundle").isin(bundles)), cov, meta)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` held for the passes of one fit, which otherwise compute it anew each time."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder that ``spark.checkpoint.dir`` names, so what follows neither plans nor computes it again.

    Where none is named, the executors hold it until the session ends or clears its cache.
    """
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist(StorageLevel.MEMORY_AND_DISK)


def small(df: DataFrame) -> DataFrame:
    """A table of a row a bundle, computed now; there are as many as regions of the brain, whatever the rows."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def metadata(name: str, ref: DataFrame, mov: DataFrame, cov: Covariates, options: Options) -> DataFrame:
    """One row: sites, metric, age range of the fitted moving rows, flags."""
    m = mov.agg(F.first("site").alias("mov_site"), F.first("metric").alias("metric_name"), F.min("age").alias("min_age"), F.max("age").alias("max_age"))
    r = ref.agg(F.first("site").alias("ref_site"))
    both = m.withColumn("_", F.lit(1)).join(r.withColumn("_", F.lit(1)), "_").drop("_")
    return both.select(F.lit(name).alias("name"), "ref_site", "mov_site", "metric_name", "min_age", "max_age", F.lit(cov.degree).alias("degree"), F.lit(len(cov.labels)).alias("nbr_beta_params"),
                       F.lit(not cov.sex).alias("ignore_sex_covariate"), F.lit(not cov.handedness).alias("ignore_handedness_covariate"), F.lit(options.bayes).alias("use_empirical_bayes"), F.lit(options.limit_age).alias("limit_age_range"))


def moments(rows: DataFrame) -> list[Column]:
    """Per bundle: rows, mean and sample deviation of the residuals of each side, and of both; NaN spreads as it does in sums."""
    side = lambda s: F.when(F.col("side") == s, F.col("residual"))
    out = [nan_if_null(F.stddev_samp("residual")).alias("sigma")]
    for s in ("ref", "mov"):
        out += [F.count_if(F.col("side") == s).alias(f"n_{s}"), F.avg(side(s)).alias(f"avg_{s}"), nan_if_null(F.stddev_samp(side(s))).alias(f"std_{s}")]
    return out


def sides(ref: DataFrame, mov: DataFrame) -> DataFrame:
    cols = ["bundle", "mean", "age", "sex", "handedness"]
    return ref.select(*cols, F.lit("ref").alias("side")).unionByName(mov.select(*cols, F.lit("mov").alias("side")))


def pairwise_effects(both: DataFrame, cov: Covariates, ridge: float = 0.0, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(bundle, intercept, betas, sigma, moments) of ``sides``: bundles that both have.  ``settle`` may compute what the second pass uses."""
    params = settle(fit(both, cov, ridge=ridge).drop("n"))
    names = names_of(cov)
    rows = residuals(with_design(both, cov), params, names)
    return rows.groupBy("bundle", *names).agg(*moments(rows)).where((F.col("n_ref") > 0) & (F.col("n_mov") > 0))


def gathered(ref: DataFrame, mov: DataFrame, options: Options, degree: int) -> tuple[DataFrame, DataFrame]:
    """Statistics of the reference, keyed by (metric, bundle), and of the moving sites, keyed by (site, metric, bundle); rows are read once.

    With an age limit, which is the range of all moving rows of a site, the reference's
    statistics are a site's too (``for_site``).
    """
    require(ref)
    require(mov)
    ref = filters.controls(ref) if options.ref_controls_only else ref
    cols = ["site", "metric", "bundle", "mean", "age", "sex", "handedness", "disease"]
    whose = F.lit(None).cast("string")
    if options.limit_age:
        span = mov.groupBy(F.col("site").alias("_site"), "metric").agg(F.min("age").alias("_lo"), F.max("age").alias("_hi"))  # a row a site and metric
        ref, whose = ref.join(span, "metric").where(F.col("age").between(F.col("_lo"), F.col("_hi"))), F.col("_site")
    both = ref.select(*cols, F.lit("ref").alias("side"), whose.alias("for_site")).unionByName(mov.select(*cols, F.lit("mov").alias("side"), F.lit(None).cast("string").alias("for_site")))
    s = small(statistics(both, degree, by=("side", "for_site", *KEYS), fitted=(F.col("side") == "ref") | (F.col("disease") == "HC")))
    return s.where("side = 'ref'").drop("side"), s.where("side = 'mov'").drop("side", "for_site")


def paired(ref: DataFrame, mov: DataFrame, options: Options, degree: int, one: bool = False) -> DataFrame:
    """A row a moving site, metric and bundle that the reference has too, with both sides' statistics (``r_``, ``v_``) and whether a covariate is usable.

    The reference must be one site; each moving site and metric needs a bundle in common
    with it.  A covariate is usable if in no bundle of either side all controls have one
    level; a level other than 1 and 2 is an error.  ``one`` asks for one site and metric.
    """
    known, rows = ref.collect(), mov.collect()  # rows are groups: sites, metrics and bundles
    distinct = lambda rs, c: {r[c] for r in rs}
    if len(distinct(known, "site")) != 1:
        raise ValueError("the reference rows must be of one site")
    if one and len(distinct(rows, "site")) != 1:
        raise ValueError("the moving rows must be of one site")
    if one and len(distinct(known, "metric") | distinct(rows, "metric")) != 1:
        raise ValueError("both sides must have one and the same metric")
    usable = []
    for site, metric in sorted({(r["site"], r["metric"]) for r in rows}):
        theirs = [r for r in known if r["metric"] == metric and (not options.limit_age or r["for_site"] == site)]
        mine = [r for r in rows if (r["site"], r["metric"]) == (site, metric)]
        if not distinct(theirs, "bundle") & {r["bundle"] for r in mine if r["n_hc"]}:
            raise ValueError(f"the sites have no bundle in common: {site}, {metric}")
        flags = []
        for c in ("sex", "handedness"):
            if any(r[f"{c}_bad"] for r in theirs + mine):
                raise ValueError(f"{c} has values other than 1 and 2")
            flags.append(getattr(options, c) and not any(r["n_hc"] and r[f"{c}_min"] == r[f"{c}_max"] for r in theirs + mine))
        usable.append((site, metric, *flags))
    if not usable:
        raise ValueError("there are no moving rows")
    flags = mov.sparkSession.createDataFrame(usable, "site string, metric string, use_sex boolean, use_handedness boolean")
    keys = {"site": "site", "metric": "metric", "bundle": "bundle"}
    side = lambda df, p: df.select(*[F.col(c).alias(keys.get(c, c if c == "for_site" else p + c)) for c in df.columns])
    theirs = side(ref.withColumnRenamed("site", "ref_site"), "r_").withColumnRenamed("r_ref_site", "ref_site")
    theirs = theirs.withColumnRenamed("for_site", "site") if options.limit_age else theirs.drop("for_site")
    on = ["site", "metric", "bundle"] if options.limit_age else ["metric", "bundle"]
    return side(mov, "v_").where("v_n_hc > 0").join(theirs, on).join(flags, ["site", "metric"])


def _used() -> dict[str, Column]:
    return {"beta_sex": F.col("use_sex"), "beta_handedness": F.col("use_handedness")}


def pairwise_params(pairs: DataFrame, degree: int, options: Options) -> DataFrame:
    """Parameters a site, metric and bundle, of ``paired``."""
    names = names_of(Covariates(degree))
    p = pairs.withColumns(pooled(degree, "r_", "v_", "p_"))
    e = coefficients(p, degree, stats="p_", out="", used=_used(), weight=options.ridge)
    e = e.select(*KEYS, *names, "use_sex", "use_handedness", F.col("v_n").alias("n"), *[f(degree, s, "").alias(c) for f, s, c in (
        (residual_sd, "p_", "sigma"), (residual_mean, "r_", "avg_ref"), (residual_sd, "r_", "std_ref"), (residual_mean, "v_", "avg_mov"), (residual_sd, "v_", "std_mov"))])
    e = small(e.withColumns({"gamma_hat": F.col("avg_mov") / F.col("sigma"), "delta_hat": F.col("std_mov") / F.col("sigma")}))
    gamma, delta = F.col("gamma_hat"), F.col("delta_hat")
    if options.bayes:
        e = e.join(empirical_bayes(e, ("site", "metric")).select(*KEYS, "gamma_star", "delta_star"), list(KEYS))
        gamma, delta = F.col("gamma_star"), F.col("delta_star")
    return small(e.select(*KEYS, "use_sex", "use_handedness", *names, "sigma", F.col("avg_ref").alias("ref_gamma"), (F.col("std_ref") / F.col("sigma")).alias("ref_delta"), (gamma * F.col("sigma")).alias("mov_gamma"), delta.alias("mov_delta")))


def clinical_params(pairs: DataFrame, degree: int, options: Options) -> DataFrame:
    """Parameters a site, metric and bundle, of ``paired``, and the ridge chosen for the site and metric."""
    from .tuning import ridges_by_curves

    r_names, m_names = names_of(Covariates(degree), "ref_"), names_of(Covariates(degree), "mov_")
    p = coefficients(pairs, degree, stats="r_", out="ref_", used=_used(), weight=options.ridge_ref).withColumn("ref_std", residual_sd(degree, "r_", "ref_"))
    if options.ridge_mov == -1:
        p = small(p)
        p = p.join(small(ridges_by_curves(p, degree, _used(), tau=options.tau)), ["site", "metric"])
    else:
        p = p.withColumn("ridge", F.lit(float(options.ridge_mov)))
    p = coefficients(p, degree, stats="v_", out="mov_", used=_used(), weight=F.col("ridge"), prior="ref_").withColumns({"mov_std": residual_sd(degree, "v_", "mov_"), "_mean": residual_mean(degree, "v_", "mov_")})
    hat = F.col("mov_std") / F.col("ref_std")
    delta = shrunk(hat, F.col("v_n"), options.nu) if options.bayes else hat
    return small(p.select(*KEYS, "use_sex", "use_handedness", "ridge", *r_names, "ref_std", *m_names, "mov_std", (F.col("_mean") / F.col("ref_std")).alias("mov_gamma"), delta.alias("mov_delta")))


def _one(kind: type, name: str, params: DataFrame, stats: tuple[DataFrame, DataFrame], degree: int, options: Options, **meta) -> Model:
    """The model of the only site and metric, without the columns of covariates that it does not use."""
    fitted = params.collect()  # a row a bundle
    r, bundles = fitted[0], {x["bundle"] for x in fitted}
    cov = Covariates(degree, r["use_sex"], r["use_handedness"])
    ages = [a for x in stats[1].collect() if x["bundle"] in bundles for a in (x["hc_age_min"], x["hc_age_max"])]
    meta = {"name": name, "ref_site": stats[0].first()["site"], "mov_site": r["site"], "metric_name": r["metric"], "min_age": min(ages), "max_age": max(ages), "use_empirical_bayes": options.bayes, "limit_age_range": options.limit_age, **meta, "options": options}
    gone = [c for c in params.columns if c in (*KEYS[:2], "use_sex", "use_handedness", "ridge") or (c.endswith("beta_sex") and not cov.sex) or (c.endswith("beta_handedness") and not cov.handedness)]
    return kind(params.drop(*gone), cov, meta)


def fit_pairwise(ref: DataFrame, mov: DataFrame, options: Options = Options()) -> Pairwise:
    degree = 1 if options.degree is None else options.degree
    stats = gathered(ref, mov, options, degree)
    pairs = paired(*stats, options, degree, one=True)
    return _one(Pairwise, "pairwise", pairwise_params(pairs, degree, options), stats, degree, options, regul=options.ridge)


def fit_clinical(ref: DataFrame, mov: DataFrame, options: Options = Options()) -> Clinical:
    degree = 2 if options.degree is None else options.degree
    stats = gathered(ref, mov, options, degree)
    params = clinical_params(paired(*stats, options, degree, one=True), degree, options)
    return _one(Clinical, "clinical", params, stats, degree, options, regul_ref=options.ridge_ref, regul_mov=params.first()["ridge"], nu=options.nu, tau=options.tau)


def fit_sites(method: str, ref: DataFrame, mov: DataFrame, options: Options = Options()) -> Model:
    """One model table, keyed by (site, metric, bundle), for every moving site and metric; equal to fits one by one.

    The rows of all sites are read once.  Each site and metric has its own usable
    covariates (an unused one has 0), ridge and empirical-Bayes priors.
    """
    kinds = {"pairwise": (Pairwise, pairwise_params, 1), "clinical": (Clinical, clinical_params, 2)}
    if method not in kinds:
        raise ValueError(f"unknown method {method}; known: {', '.join(kinds)}")
    _, _, least = kinds[method]
    degree = least if options.degree is None else options.degree
    return fit_statistics(method, *gathered(ref, mov, options, degree), degree, options)


def fit_statistics(method: str, ref: DataFrame, mov: DataFrame, degree: int, options: Options = Options()) -> Model:
    """As ``fit_sites``, of statistics that have been stored; no observation is read."""
    kind, params = {"pairwise": (Pairwise, pairwise_params), "clinical": (Clinical, clinical_params)}[method]
    ref = ref if "for_site" in ref.columns else ref.withColumn("for_site", F.lit(None).cast("string"))
    return kind(params(paired(ref, mov, options, degree), degree, options), Covariates(degree), {"name": method, "options": options}, KEYS)


METHODS = {"pairwise": fit_pairwise, "clinical": fit_clinical}


def fit_model(method: str, ref: DataFrame, mov: DataFrame, options: Options = Options()) -> Model:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    return METHODS[method](ref, mov, options)
