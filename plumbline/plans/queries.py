"""Every operator as a query over the cohort of a data folder."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, quality, regression, simulate, site_effect, statistics, subjects, summary, tuning
from ..operators import windows as w
from ..operators.models import Options, fit_clinical, fit_pairwise, fit_sites, fit_statistics, metadata, pairwise_effects, prepared, settled, sides, small
from ..operators.regression import Covariates, names_of
from ..sources import sinks
from ..sources.cohort import MOVING, REFERENCE, cohort, moving, reference
from ..sources.observations import keep_first, normalise, union_sites
from . import jobs

#: Digits of values taken from the tables as they are.
FINE = 6
LINE, CURVE = Covariates(1), Covariates(2)
CLINICAL = Options(degree=2)
PAIRWISE = Options(degree=1)
PERCENTILES = (5.0, 25.0, 50.0, 75.0, 95.0)
LOO_RIDGES = [float(x * x) / 4 for x in range(21)]
SITES_KNOWN = {"ASIA": "Siemens", "EUROPE": "GE"}
BUNDLES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    """Registers ``f(obs, ref, mov)``: the cohort, its reference rows, its moving controls; ``other`` is its cohort of another metric."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        obs = cohort(spark, sf_dir)
        more = {"other": cohort(spark, sf_dir, "qty")} if "other" in inspect.signature(f).parameters else {}
        return f(obs, reference(obs), moving(obs), **more)

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return f


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """All doubles rounded, as sums differ in their last bits with the order of rows.

    Three digits more are rounded first: averages of few decimals often lie exactly
    half-way between two numbers, where else the last bit would decide.
    """
    near = lambda c: F.round(F.round(c * 10.0 ** (digits + 3)) / 1000.0) / 10.0**digits + 0.0
    return df.select(*[near(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def scan_cohort(obs, ref, mov):
    return rounded(obs, FINE)


@query
def dedupe_keep_first(obs, ref, mov):
    twice = obs.unionByName(obs.withColumn("mean", F.col("mean") + 1.0))
    return rounded(keep_first(twice, ("sid", "site", "bundle", "metric", "age", "sex", "handedness", "disease"), "mean"), FINE)


@query
def filter_predicates(obs, ref, mov):
    return rounded(obs.where(filters.predicate(site=[REFERENCE, MOVING], disease="HC", sex=1, age=(30, 50))), FINE)


@query
def hc_filter_counts(obs, ref, mov):
    return summary.counts_by(filters.controls(obs), "site", "bundle")


@query
def ignore_bundles(obs, ref, mov):
    return summary.counts_by(filters.ignore_bundles(obs, ["ECONOMY", "LARGE"]), "bundle")


@query
def limit_age_range(obs, ref, mov):
    return summary.counts_by(filters.limit_age_range(ref, mov.where(F.col("age").between(30, 40))), "bundle", "age")


@query
def bundle_intersection(obs, ref, mov):
    return filters.common_bundles(ref.where("bundle <> 'ECONOMY'"), mov.where("bundle <> 'LARGE'"))


@query
def covariate_levels(obs, ref, mov):
    return filters.covariate_levels(filters.controls(obs))


@query
def site_metric_checks(obs, ref, mov):
    return filters.site_metric_counts(obs)


@query
def valid_sites(obs, ref, mov):
    return filters.valid_sites(obs, least=10, metric="price", bundle="ECONOMY")


@query
def design_rows(obs, ref, mov):
    return regression.with_design(mov, CURVE).select("sid", "bundle", *[f"x{k}" for k in range(CURVE.size)])


@query
def site_labels(obs, ref, mov):
    names = F.explode(F.array("site", F.concat("site", F.lit("_Philips_3T")), F.concat("site", F.lit("_siemens_3t")), F.concat("site", F.lit("_GE")))).alias("site")
    site = F.col("site")
    return obs.select("site").distinct().select(names).select("site", filters.manufacturer(site, reference=REFERENCE, known=SITES_KNOWN).alias("manufacturer"), filters.label_site(site, reference=REFERENCE, reference_name="ref", known=SITES_KNOWN).alias("label_site"))


@query
def site_metadata(obs, ref, mov):
    """A metadata table with the maker in its 14th and the site in its 16th column."""
    rows = obs.select("site").distinct().withColumn("maker", F.when(F.col("site") == "ASIA", "").when(F.col("site") != "EUROPE", "GE"))
    table = rows.select(*[F.lit("-").alias(f"c{k}") for k in range(13)], F.col("maker").alias("c13"), F.lit("-").alias("c14"), F.col("site").alias("c15"))
    return obs.join(filters.site_makers(table, REFERENCE), "site", "left").groupBy("site", "manufacturer").agg(F.count("*").alias("n"))


def _sided(obs):
    ending = F.element_at(F.array(F.lit("_L"), F.lit("_R"), F.lit("")), F.length("bundle") % 3 + 1)
    return obs.select(F.concat("bundle", ending).alias("bundle")).distinct().select("bundle", filters.side(F.col("bundle")).alias("side"))


@query
def bundle_side(obs, ref, mov):
    return _sided(obs)


@query
def bundle_sides_table(obs, ref, mov):
    return summary.sides_table(_sided(obs))


@query
def gram_by_bundle(obs, ref, mov):
    return rounded(regression.gram(regression.with_design(mov, CURVE), CURVE.size), 3)


@query
def ols_fit_by_bundle(obs, ref, mov):
    return rounded(regression.fit(ref, CURVE))


def _with_prior(ref, mov):
    r, m = names_of(CURVE, "ref_"), names_of(CURVE, "mov_")
    grams = regression.gram(regression.with_design(mov, CURVE), CURVE.size).drop("n").join(regression.fit(ref, CURVE, prefix="ref_").drop("n"), "bundle")
    return regression.solve(regression.with_ridge(grams, CURVE.size, 0.01, [F.col(c) for c in r]), CURVE.size, m)


@query
def ridge_prior_fit(obs, ref, mov):
    return rounded(_with_prior(ref, mov).select("bundle", *names_of(CURVE, "mov_")))


@query
def residual_sigma(obs, ref, mov):
    rows = regression.residuals(regression.with_design(ref, CURVE), regression.fit(ref, CURVE), names_of(CURVE))
    return rounded(rows.groupBy("bundle").agg(F.count("*").alias("n_rows"), F.stddev_samp("residual").alias("sigma")))


@query
def standardize_pairwise(obs, ref, mov):
    return rounded(fit_pairwise(ref, mov, PAIRWISE).standardised(mov).select("sid", "bundle", "z"))


@query
def standardize_clinical(obs, ref, mov):
    return rounded(fit_clinical(ref, mov, CLINICAL).standardised(mov).select("sid", "bundle", "z"))


def _effects(ref, mov):
    e = pairwise_effects(sides(ref, mov), LINE)
    return e.select("bundle", F.col("n_mov").alias("n"), (F.col("avg_mov") / F.col("sigma")).alias("gamma_hat"), (F.col("std_mov") / F.col("sigma")).alias("delta_hat"))


@query
def site_effect_raw(obs, ref, mov):
    return rounded(_effects(ref, mov))


@query
def eb_priors(obs, ref, mov):
    return rounded(site_effect.priors(_effects(ref, mov)), 4)


@query
def eb_estimate(obs, ref, mov):
    return rounded(site_effect.empirical_bayes(_effects(ref, mov)))


@query
def variance_shrinkage(obs, ref, mov):
    return rounded(_effects(ref, mov).select("bundle", site_effect.shrunk(F.col("delta_hat"), F.col("n"), 5.0).alias("delta")))


@query
def pairwise_model(obs, ref, mov):
    return rounded(fit_pairwise(ref, mov, PAIRWISE).params)


@query
def clinical_model(obs, ref, mov):
    return rounded(fit_clinical(ref, mov, CLINICAL).params)


@query
def predict_curve(obs, ref, mov):
    m = fit_clinical(ref, mov, CLINICAL)
    ages = F.sequence(F.lit(20), F.lit(89))
    return rounded(m.curve(ages, moving=False).withColumn("side", F.lit("ref")).unionByName(m.curve(ages).withColumn("side", F.lit("mov"))))


def _others(obs):
    """Controls of every site but the reference."""
    return filters.controls(obs).where(F.col("site") != REFERENCE)


@query
def pairwise_models_sites(obs, ref, mov, other):
    """Models of all other sites and two metrics, in one pass."""
    both = obs.unionByName(other)
    m = fit_sites("pairwise", reference(both), _others(both), PAIRWISE)
    return rounded(m.params.drop("use_sex", "use_handedness"))


@query
def clinical_models_sites(obs, ref, mov):
    """Models of all other sites, each with its own ridge."""
    return rounded(fit_sites("clinical", ref, _others(obs), CLINICAL).params.drop("use_sex", "use_handedness"))


@query
def apply_sites(obs, ref, mov):
    """All subjects of all other sites on the reference's scale, by one table of models."""
    return rounded(fit_sites("pairwise", ref, _others(obs), PAIRWISE).apply(obs.where(F.col("site") != REFERENCE)))


def _arrivals(df, degree):
    """Statistics of four arrivals, each by itself."""
    hc = F.col("disease") == "HC"
    fitted = (F.col("site") == REFERENCE) | hc
    return statistics.statistics(df.withColumn("arrival", F.col("sid") % 4), degree, by=("arrival", *statistics.KEYS), fitted=fitted)


@query
def statistics_merged(obs, ref, mov):
    s = statistics.merged(_arrivals(obs, 2), 2)
    return rounded(s.select(*statistics.KEYS, "n", "n_hc", "fit_age_min", "fit_age_max", *[c for c in statistics.moment_columns(2) if "age2" not in c]), 4)


@query
def refit_after_arrivals(obs, ref, mov):
    """A fit of merged statistics; it reads no observation."""
    s = statistics.merged(_arrivals(obs.where(F.col("site").isin(REFERENCE, MOVING)), 1), 1)
    m = fit_statistics("pairwise", s.where(F.col("site") == REFERENCE), s.where(F.col("site") == MOVING), 1, PAIRWISE)
    return rounded(m.params.drop("use_sex", "use_handedness"))


def _narrow(mov):
    return mov.where((F.col("age") >= 30) & (F.col("age") < 36))


@query
def tune_objective(obs, ref, mov):
    return rounded(tuning.objective(ref, mov, CURVE, ridge_ref=0.0, tau=2.0))


@query
def tune_lambda(obs, ref, mov):
    return rounded(tuning.tune(ref, mov, CURVE, ridge_ref=0.0, tau=2.0), 6)


@query
def tune_objective_narrow(obs, ref, mov):
    """A moving site of few ages, where the first ridges do not pass."""
    return rounded(tuning.objective(ref, _narrow(mov), CURVE, ridge_ref=0.0, tau=2.0))


@query
def tune_lambda_narrow(obs, ref, mov):
    return rounded(tuning.tune(ref, _narrow(mov), CURVE, ridge_ref=0.0, tau=2.0), 6)


@query
def pairwise_limited_ages(obs, ref, mov):
    """The reference within the ages of all moving rows: patients here are of more ages than controls."""
    wide = F.when(F.col("disease") == "HC", F.col("age").between(30, 60)).otherwise(F.col("age").between(25, 70))
    return rounded(fit_pairwise(ref, obs.where((F.col("site") == MOVING) & wide), Options(degree=1, limit_age=True)).params)


@query
def pairwise_apply(obs, ref, mov):
    """All subjects of the moving site, not only its controls."""
    return rounded(fit_pairwise(ref, mov, PAIRWISE).apply(obs.where(F.col("site") == MOVING)))


@query
def clinical_apply(obs, ref, mov):
    return rounded(fit_clinical(ref, mov, CLINICAL).apply(obs.where(F.col("site") == MOVING)))


@query
def fit_metadata(obs, ref, mov):
    p = prepared(ref, mov, PAIRWISE, 1)
    return metadata("pairwise", p.ref, p.mov, p.cov, PAIRWISE)


@query
def loo_error(obs, ref, mov):
    return rounded(tuning.leave_one_out(ref, mov, LINE, [0.0]), 4)


@query
def loo_grid(obs, ref, mov):
    return rounded(tuning.leave_one_out(ref, mov, LINE, LOO_RIDGES), 4)


@query
def loo_best(obs, ref, mov):
    return rounded(tuning.best_ridge(tuning.leave_one_out(ref, mov, LINE, LOO_RIDGES)), 4)


@query
def bhattacharyya_raw(obs, ref, mov):
    return rounded(quality.distances(ref, mov, CURVE), 6)


@query
def bhattacharyya_harmonized(obs, ref, mov):
    return rounded(quality.check(m := fit_clinical(ref, mov, CLINICAL), ref, m.apply(mov)), 6)


@query
def qc_summary(obs, ref, mov):
    return rounded(quality.summary(quality.distances(ref, mov, CURVE)), 6)


@query
def cohens_d(obs, ref, mov):
    return rounded(quality.cohens_d(filters.controls(obs), REFERENCE, MOVING), 6)


def _curves(df):
    return w.mean_curve(df)


@query
def window_effect_size(obs, ref, mov):
    return rounded(quality.window_effect(_curves(filters.controls(ref)), _curves(mov)))


@query
def info_counts(obs, ref, mov):
    return summary.counts_by(obs, "site", "disease", "sex", "handedness")


@query
def info_age_range(obs, ref, mov):
    return summary.ages_by(obs, "site", "disease")


@query
def info_categories(obs, ref, mov):
    return summary.categories(obs)


@query
def normalise_results(obs, ref, mov):
    """Controls under another name, every row twice, and a first row without a value for every fifth subject."""
    named = obs.withColumn("disease", F.when((F.col("disease") == "HC") & (F.col("sid") % 2 == 0), "NC").otherwise(F.col("disease")))
    gap = named.withColumn("mean", F.when(F.col("sid") % 5 != 0, F.col("mean")))
    twice = gap.unionByName(named.withColumn("mean", F.col("mean") + 1.0))
    return rounded(normalise(twice, order="mean"), FINE)


@query
def info_global(obs, ref, mov):
    return summary.overview(obs)


@query
def subject_mean_std(obs, ref, mov):
    return rounded(subjects.subject_spread(obs, "mean"))


@query
def subject_median_mad(obs, ref, mov):
    return rounded(subjects.subject_spread(obs, "median"), FINE)


@query
def histogram_common_bins(obs, ref, mov):
    return rounded(summary.histogram(obs), 4)


@query
def boxplot_stats(obs, ref, mov):
    return rounded(summary.box_stats(obs, ["site", "bundle"]), FINE)


@query
def y_limits(obs, ref, mov):
    return rounded(summary.limits(obs), FINE)


@query
def kernel_density(obs, ref, mov):
    return rounded(summary.density(ref), 8)


def _window_counts(df):
    return df.groupBy("bundle", "centre", "widened").agg(F.count("*").alias("n"))


@query
def window_static(obs, ref, mov):
    return _window_counts(w.windows(mov, mode=w.STATIC))


@query
def window_dynamic(obs, ref, mov):
    return _window_counts(w.windows(mov, width=2, least=12))


@query
def window_no_dynamic(obs, ref, mov):
    return _window_counts(w.windows(mov, width=2, least=12, mode=w.NOT_DYNAMIC))


@query
def window_trimmed(obs, ref, mov):
    return w.trimmed(mov, width=4, least=12).groupBy("bundle", "centre").agg(F.count("*").alias("n"))


@query
def window_sampled(obs, ref, mov):
    return w.trimmed(mov, width=4, least=12, most=9).select("bundle", "centre", "sid")


@query
def percentile_curve(obs, ref, mov):
    p = tuple(x / 100 for x in PERCENTILES)
    return rounded(w.window_percentiles(filters.controls(ref), p), FINE)


@query
def mean_sd_curve(obs, ref, mov):
    return rounded(_curves(filters.controls(ref)))


@query
def subject_reference_window(obs, ref, mov):
    return rounded(w.around_subjects(filters.controls(ref), mov))


@query
def subject_reference_window_median(obs, ref, mov):
    return rounded(w.around_subjects(filters.controls(ref), mov, method="median"), FINE)


@query
def single_subject_output(obs, ref, mov):
    hc = filters.controls(ref)
    return rounded(subjects.output(hc, mov, subjects.harmonize_subjects(hc, mov)))


@query
def single_subject_bundle_data(obs, ref, mov):
    return rounded(subjects.bundle_data(mov))


@query
def single_subject(obs, ref, mov):
    return rounded(subjects.harmonize_subjects(filters.controls(ref), mov))


@query
def harmonization_distance(obs, ref, mov):
    other = fit_clinical(ref, mov, CLINICAL).apply(mov).where("bundle <> 'LARGE'")
    return rounded(subjects.compare(subjects.harmonize_subjects(filters.controls(ref), mov), other), 4)


@query
def corrupt_data(obs, ref, mov):
    return rounded(simulate.corrupt(mov, LINE, mult=90, add=110, slope=75))


@query
def subsample_sids(obs, ref, mov):
    return rounded(simulate.sample_subjects(obs, 20), FINE)


@query
def harmonized_result(obs, ref, mov):
    m = fit_pairwise(ref, mov.where("bundle <> 'LARGE'"), PAIRWISE)
    return rounded(sinks.harmonized_result(m.apply(mov), m.params, method="pairwise", model="mov-ref.price.model.csv"))


@query
def qc_wide(obs, ref, mov):
    return rounded(sinks.qc_wide(quality.distances(ref, mov, CURVE), quality.subjects_checked(mov), BUNDLES), 6)


@query
def plot_json(obs, ref, mov):
    points = rounded(_curves(mov).select("bundle", F.lit("price").alias("metric"), F.col("centre").alias("x"), F.col("average").alias("y")), 4)
    return sinks.plot_json(points, "line")


@query
def plot_merge(obs, ref, mov):
    """A file of plots in a group, another that replaces one of them and adds one without a group; merged, written and read again."""
    curve = small(rounded(_curves(mov), 4))  # a row a bundle and year
    line = lambda group, name, y: sinks.plot_json(curve.select("bundle", F.lit("price").alias("metric"), F.col("centre").alias("x"), F.col(y).alias("y")), "line").select("bundle", "metric", F.lit(group).cast("string").alias("plot_group"), F.lit(name).alias("plot_name"), "plot")
    old = line("windows", "average", "average").unionByName(line("windows", "n", "n"))
    new = line("windows", "average", "deviation").unionByName(line(None, "count", "n"))
    old, new = (sinks.read_plot_documents(sinks.plot_documents(t)) for t in (old, new))
    return sinks.plot_documents(sinks.merge_named_plots(old, new))


@query
def curve_layers(obs, ref, mov):
    """All layers of a view: single-subject rows with error bars to the clinical harmonization."""
    other = fit_clinical(ref, mov, CLINICAL).apply(mov)
    compared = subjects.compare(subjects.harmonize_subjects(filters.controls(ref), mov), other).withColumn("model", F.lit("single_subject"))
    return rounded(jobs.curve_layers(settled(ref), settled(compared), lower="err_lower", upper="err_upper", percentiles=(0.5,)), 4)


@query
def model_text(obs, ref, mov):
    return rounded(sinks.model_table(fit_clinical(ref, mov, CLINICAL)))


@query
def model_round_trip(obs, ref, mov):
    """A model written as text and read again."""
    m = fit_clinical(ref, mov, CLINICAL)
    return rounded(sinks.read_model(obs.sparkSession, sinks.model_text(m)).params.select(*m.params.columns))


@query
def fit_apply_check(obs, ref, mov):
    """The whole run on all rows of the moving site: distances before and after.  Both sites' rows are drawn from the tables once."""
    rows = settled(obs.where(F.col("site").isin(REFERENCE, MOVING)))
    out = jobs.fit_apply_check(reference(rows), rows.where(F.col("site") == MOVING), method="clinical", options=CLINICAL)
    both = out["raw_distances"].withColumn("stage", F.lit("raw")).unionByName(out["harmonized_distances"].withColumn("stage", F.lit("harmonized")))
    return rounded(both, 6)


@query
def data_view(obs, ref, mov):
    return rounded(jobs.data_view(obs, dataset="site"), FINE)


@query
def model_view(obs, ref, mov):
    m = fit_clinical(ref, mov, CLINICAL)
    return rounded(jobs.model_view(m, ref, obs.where(F.col("site") == MOVING)))


@query
def curve_view(obs, ref, mov):
    """Raw and pairwise-harmonized rows of the moving site, each a view."""
    tag = lambda df, name: df.withColumns({"harmonization": F.lit(name), "model": F.lit(name)})
    moved = tag(mov, "raw").unionByName(tag(fit_pairwise(ref, mov, PAIRWISE).apply(mov), "pairwise"))
    return rounded(jobs.curve_view(tag(ref, "raw"), moved))


def union_sites_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics' tables, one with a column more."""
    both = union_sites(cohort(spark, sf_dir), cohort(spark, sf_dir, "qty").withColumn("scanner", F.lit("s1")))
    return both.groupBy("metric", "site", "scanner").agg(F.count("*").alias("n"))


QUERIES["union_sites"] = union_sites_query
