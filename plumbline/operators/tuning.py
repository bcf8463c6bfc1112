"""Choosing the moving site's ridge: by distance between curves, or by leaving subjects out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regression import EPSILON, Covariates, dot, fit, gram, names_of, solve, with_design, with_ridge
from .statistics import coefficients

LARGEST = 1e10


def candidates(first: float = 0.01, factor: float = 1.5, largest: float = LARGEST) -> list[float]:
    """Ridges by repeated multiplication, below the largest."""
    out = [first]
    while out[-1] * factor < largest:
        out.append(out[-1] * factor)
    return out


def objective(ref: DataFrame, mov: DataFrame, cov: Covariates, *, ridge_ref: float, tau: float, ridges: list[float] | None = None) -> DataFrame:
    """(bundle, ridge, v): 0 if the curves' distance over all ages is within ``tau`` of that over the moving ages.

    All candidates are fitted in one job: bundles x candidates rows, each with the grid
    of whole ages as an array.
    """
    lo, hi = ref.agg(F.floor(F.min("age")).cast("int"), F.ceil(F.max("age")).cast("int")).first()
    if lo is None:
        raise ValueError("the reference has no rows")
    seen = mov.select(F.explode(F.array(F.floor("age").cast("int"), F.ceil("age").cast("int"))).alias("a")).where(F.col("a").between(lo, hi)).distinct()
    ages = sorted(r["a"] for r in seen.collect())  # whole years between two bounds
    r_names, m_names = names_of(cov, "ref_"), names_of(cov, "mov_")
    of_ref = fit(ref, cov, ridge=ridge_ref, prefix="ref_").drop("n")
    g = gram(with_design(mov, cov), cov.size).drop("n").join(of_ref, "bundle")
    each = g.select("*", F.explode(F.array(*map(F.lit, ridges or candidates()))).alias("ridge"))
    params = solve(with_ridge(each, cov.size, F.col("ridge"), [F.col(c) for c in r_names]), cov.size, m_names)
    gap = [F.col(r) - F.col(m) for r, m in zip(r_names, m_names, strict=True)]
    over = lambda grid: F.transform(grid, lambda a: dot(cov.at(a.cast("double")), gap))
    far = params.select("bundle", "ridge", over(F.sequence(F.lit(lo), F.lit(hi))).alias("all"), over(F.array(*map(F.lit, ages)) if ages else F.array().cast("array<int>")).alias("some"))
    at = lambda f, c: F.abs(f(F.col(c)))
    v: Column = F.signum(at(F.array_min, "some") / F.lit(float(tau)) - at(F.array_min, "all")) + F.signum(at(F.array_max, "all") - at(F.array_max, "some") * F.lit(float(tau))) + 2
    return far.select("bundle", "ridge", v.alias("v"))


def tune(ref: DataFrame, mov: DataFrame, cov: Covariates, *, ridge_ref: float, tau: float, ridges: list[float] | None = None) -> DataFrame:
    """One row, ``ridge``: the smallest candidate whose objective is 0 for every bundle, else the largest allowed."""
    total = objective(ref, mov, cov, ridge_ref=ridge_ref, tau=tau, ridges=ridges).groupBy("ridge").agg(F.sum("v").alias("v"))
    return total.agg(F.coalesce(F.min(F.when(F.col("v") == 0, F.col("ridge"))), F.lit(LARGEST)).alias("ridge"))


def ridges_by_curves(pairs: DataFrame, degree: int, used: dict[str, Column], *, tau: float, ridges: list[float] | None = None) -> DataFrame:
    """(site, metric, ridge): ``tune`` of many sites and metrics at once, from statistics alone.

    ``pairs`` has the moving statistics (``v_``), those of the reference (``r_``) and its
    coefficients (``ref_``); rows are sites, metrics, bundles and candidates.
    """
    cov, model = Covariates(degree), ["site", "metric"]
    r_names, m_names = names_of(cov, "ref_"), names_of(cov, "mov_")
    span = pairs.groupBy(*model).agg(F.floor(F.min("r_fit_age_min")).cast("int").alias("lo"), F.ceil(F.max("r_fit_age_max")).cast("int").alias("hi"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("v_years")))).alias("years"))
    each = pairs.join(span, model).select("*", F.explode(F.array(*map(F.lit, ridges or candidates()))).alias("ridge"))
    params = coefficients(each, degree, stats="v_", out="mov_", used=used, weight=F.col("ridge"), prior="ref_")
    half = [F.lit(1.0), *[F.when(used[x], 0.5).otherwise(0.0) if x in used else F.lit(None) for x in cov.labels]]
    gap = [F.col(r) - F.col(m) for r, m in zip(r_names, m_names, strict=True)]

    def distance(age: Column) -> Column:
        x, power = list(half), None
        for k in range(degree):
            power = age if power is None else power * age
            x[len(x) - degree + k] = power
        return dot(x, gap)

    over = lambda grid: F.transform(grid, lambda a: distance(a.cast("double")))
    far = params.select(*model, "bundle", "ridge", over(F.sequence("lo", "hi")).alias("all"), over(F.filter("years", lambda a: a.between(F.col("lo"), F.col("hi")))).alias("some"))
    at = lambda f, c: F.abs(f(F.col(c)))
    v = F.signum(at(F.array_min, "some") / F.lit(float(tau)) - at(F.array_min, "all")) + F.signum(at(F.array_max, "all") - at(F.array_max, "some") * F.lit(float(tau))) + 2
    total = far.groupBy(*model, "ridge").agg(F.sum(v).alias("v"))
    return total.groupBy(*model).agg(F.coalesce(F.min(F.when(F.col("v") == 0, F.col("ridge"))), F.lit(LARGEST)).alias("ridge"))


def inverse(df: DataFrame, size: int) -> DataFrame:
    """``df`` with i0_0.. of the inverse of the symmetric matrix a0_0..; null where it is singular.  a0_0.. stay."""
    held = [f"a{i}_{j}" for i in range(size) for j in range(i, size)]
    for column in range(size):
        unit = df.withColumns({f"_{c}": F.col(c) for c in held} | {f"b{i}": F.lit(1.0 if i == column else 0.0) for i in range(size)})
        df = solve(unit, size, [f"i{row}_{column}" for row in range(size)]).withColumnsRenamed({f"_{c}": c for c in held})
    return df


def leave_one_out(ref: DataFrame, mov: DataFrame, cov: Covariates, ridges: list[float], *, ridge_ref: float = 0.0) -> DataFrame:
    """(ridge, mse): squared errors of each moving subject, predicted by a model that has not seen it.

    The whole system is inverted once a bundle and ridge, about the covariates' means.  A
    subject with one row in a bundle is taken out by a rank-one step: what its row weighs
    in its own prediction says how the coefficients change.  Where nearly all of it is its
    own, the rest do not determine a model, and the fold has none.  Subjects with more
    rows in a bundle have their sums taken from the total.  Covariates are those of the
    whole fit.
    """
    m_names, r_names = names_of(cov, "mov_"), names_of(cov, "ref_")
    of_ref = fit(ref, cov, ridge=ridge_ref, prefix="ref_").drop("n")
    finite = F.col("mean").isNotNull() & ~F.isnan("mean") & (F.abs("mean") != float("inf"))
    design = with_design(mov.where(finite), cov)
    own = design.groupBy("bundle", "sid").agg(F.count("*").alias("rows"), F.max("age").alias("age"), F.max("mean").alias("mean"), *[F.max(f"x{k}").alias(f"x{k}") for k in range(cov.size)])
    one = _rank_one(design, own.where("rows = 1"), of_ref, cov, ridges)
    several = own.where("rows > 1").select("bundle", "sid")
    size = cov.size
    sums = [f"a{i}_{j}" for i in range(size) for j in range(i, size)] + [f"b{i}" for i in range(size)]
    theirs = design.join(several, ["bundle", "sid"], "left_semi")
    total = gram(design, size).drop("n")
    fold = total.select("bundle", *[F.col(c).alias(f"t_{c}") for c in sums]).join(gram(theirs, size, ("bundle", "sid")).drop("n"), "bundle").select("bundle", "sid", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in sums])
    each = fold.join(of_ref, "bundle").select("*", F.explode(F.array(*map(F.lit, ridges))).alias("ridge"))
    params = solve(with_ridge(each, size, F.col("ridge"), [F.col(c) for c in r_names]), size, m_names)
    seen = theirs.groupBy("bundle", "sid").agg(F.min_by("mean", "age").alias("mean"), F.min("age").alias("age"))
    error = F.col("mean") - dot(cov.at(F.col("age").cast("double")), [F.col(c) for c in m_names])
    many = params.join(seen, ["bundle", "sid"]).select("ridge", error.alias("error"))
    return one.unionByName(many).groupBy("ridge").agg(F.avg(F.col("error") * F.col("error")).alias("mse"))


#: What is left of a row's weight for the others, below which they determine no model.
LEFT = 1e-9


def _rank_one(design: DataFrame, subjects: DataFrame, of_ref: DataFrame, cov: Covariates, ridges: list[float]) -> DataFrame:
    """(ridge, error) of the subjects' only rows in a bundle."""
    p = cov.size - 1
    x, r_names = [F.col(f"x{k + 1}") for k in range(p)], names_of(cov, "ref_")
    n = F.count("*")
    sums = [n.alias("n"), F.avg("mean").alias("my"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(x)]]
    sums += [(F.covar_pop(x[i], x[j]) * n).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)] + [(F.covar_pop(x[i], "mean") * n).alias(f"c{i}") for i in range(p)]
    whole = design.groupBy("bundle").agg(*sums).join(of_ref, "bundle").select("*", F.explode(F.array(*map(F.lit, ridges))).alias("ridge"))
    near = [F.col(c) + F.lit(EPSILON) for c in r_names]
    pull = [F.col("ridge") * F.abs(F.try_divide(near[0], near[k + 1])) for k in range(p)]
    whole = inverse(whole.withColumns({f"a{k}_{k}": F.col(f"a{k}_{k}") + pull[k] for k in range(p)}), p) if p else whole
    slope = {f"s{k}": sum(((F.col(f"c{j}") + pull[j] * near[j + 1]) * F.col(f"i{k}_{j}") for j in range(p)), F.lit(0.0)) for k in range(p)}
    whole = whole.withColumns(slope).select("bundle", "ridge", "n", "my", *[f"m{k}" for k in range(p)], *slope, *[f"i{i}_{j}" for i in range(p) for j in range(p)])
    apart = [x[k] - F.col(f"m{k}") for k in range(p)]
    level = [c - F.col(f"m{k}") for k, c in enumerate(cov.at(F.col("age").cast("double"))[1:])]
    through = lambda u: F.lit(1.0) / F.col("n") + sum((u[i] * F.col(f"i{i}_{j}") * apart[j] for i in range(p) for j in range(p)), F.lit(0.0))
    at = lambda u: F.col("my") + sum((u[k] * F.col(f"s{k}") for k in range(p)), F.lit(0.0))
    rows = subjects.join(whole, "bundle").select("ridge", "mean", (F.col("mean") - at(apart)).alias("gap"), (F.lit(1.0) - through(apart)).alias("left"), through(level).alias("shift"), at(level).alias("said"))
    return rows.select("ridge", F.when(F.col("left") > LEFT, F.col("mean") - F.col("said") + F.col("shift") * F.col("gap") / F.col("left")).alias("error"))


def best_ridge(errors: DataFrame) -> DataFrame:
    """One row: the ridge of the least error of ``leave_one_out``, the smaller one of equals, and that error."""
    return errors.agg(F.min(F.struct("mse", "ridge")).alias("x")).select("x.ridge", "x.mse")
