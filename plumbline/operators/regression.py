"""Covariate regression per group, from sums of products and an unrolled elimination."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Covariates:
    """Regressors of a model: intercept, sex and handedness if used, powers of age."""

    degree: int = 1
    sex: bool = True
    handedness: bool = True

    def __post_init__(self):
        if self.degree < 0:
            raise ValueError("degree must not be negative")

    @property
    def labels(self) -> list[str]:
        return ["beta_sex"] * self.sex + ["beta_handedness"] * self.handedness + [f"beta_age{k + 1}" for k in range(self.degree)]

    @property
    def size(self) -> int:
        return 1 + len(self.labels)

    def only(self, usable: dict[str, bool]) -> Covariates:
        return replace(self, sex=self.sex and usable["sex"], handedness=self.handedness and usable["handedness"])

    def columns(self) -> list[Column]:
        """x0.. of a row; powers of age are products, so an integer age does not overflow or change type."""
        code = lambda c: F.when(F.col(c) == 2, 1.0).otherwise(0.0)
        out, power = [F.lit(1.0)] + [code("sex")] * self.sex + [code("handedness")] * self.handedness, None
        for _ in range(self.degree):
            power = F.col("age").cast("double") if power is None else power * F.col("age").cast("double")
            out.append(power)
        return out

    def at(self, age: Column) -> list[Column]:
        """Regressors at an age with covariates half-way between their levels."""
        out, power = [F.lit(1.0)] + [F.lit(0.5)] * (self.sex + self.handedness), None
        for _ in range(self.degree):
            power = age if power is None else power * age
            out.append(power)
        return out


def with_design(df: DataFrame, cov: Covariates) -> DataFrame:
    return df.select("*", *[c.alias(f"x{k}") for k, c in enumerate(cov.columns())])


def dot(xs: Sequence[Column], coefficients: Sequence[Column]) -> Column:
    out = None
    for x, c in zip(xs, coefficients, strict=True):
        out = x * c if out is None else out + x * c
    return out


def gram_columns(size: int, y: str = "mean") -> dict[str, Column]:
    x = [F.col(f"x{k}") for k in range(size)]
    out = {f"a{i}_{j}": F.sum(x[i] * x[j]) for i in range(size) for j in range(i, size)}
    return out | {f"b{i}": F.sum(x[i] * F.col(y)) for i in range(size)}


def gram(design: DataFrame, size: int, by: Sequence[str] = ("bundle",), y: str = "mean") -> DataFrame:
    """Sums of products of x0.. and y in each group, over rows with a finite y.

    The sums are combined before the shuffle, so each task sends one row per group.
    """
    finite = F.col(y).isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    return design.where(finite).groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in gram_columns(size, y).items()])


def with_ridge(grams: DataFrame, size: int, weight: Column | float, prior: Sequence[Column] | None = None) -> DataFrame:
    """A ridge on all but the intercept, scaled by the prior's size, that pulls towards the prior."""
    w = [p + F.lit(EPSILON) for p in prior] if prior else [F.lit(EPSILON)] * size
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    add = {}
    for k in range(1, size):
        r = weight * F.abs(F.try_divide(w[0], w[k]))
        add |= {f"a{k}_{k}": F.col(f"a{k}_{k}") + r, f"b{k}": F.col(f"b{k}") + r * w[k]}
    return grams.withColumns(add)


def solve(grams: DataFrame, size: int, names: Sequence[str]) -> DataFrame:
    """The groups' coefficients under ``names``; null where the system is singular.

    One projection a pivot keeps the expressions small; all stay in generated code.
    """
    df, a, b = grams, (lambda i, j: F.col(f"a{i}_{j}")), (lambda i: F.col(f"b{i}"))
    for p in range(size):
        step = {}
        for i in range(p + 1, size):
            f = F.try_divide(a(p, i), a(p, p))
            step |= {f"a{i}_{j}": a(i, j) - f * a(p, j) for j in range(i, size)} | {f"b{i}": b(i) - f * b(p)}
        df = df.withColumns(step) if step else df
    for p in reversed(range(size)):
        rest = b(p)
        for j in range(p + 1, size):
            rest = rest - a(p, j) * F.col(names[j])
        df = df.withColumn(names[p], F.try_divide(rest, a(p, p)))
    return df.drop(*[f"a{i}_{j}" for i in range(size) for j in range(i, size)], *[f"b{i}" for i in range(size)])


def nan_if_null(c: Column) -> Column:
    """The sample deviation of one row: NaN, not null."""
    return F.coalesce(c, F.lit(float("nan")))


def residuals(design: DataFrame, params: DataFrame, names: Sequence[str], by: Sequence[str] = ("bundle",), y: str = "mean") -> DataFrame:
    """Rows with ``residual``, for groups that have parameters."""
    xs = [F.col(f"x{k}") for k in range(len(names))]
    return design.join(params, list(by)).withColumn("residual", F.col(y) - dot(xs, [F.col(n) for n in names]))


def fit(df: DataFrame, cov: Covariates, *, ridge: float = 0.0, prefix: str = "", by: Sequence[str] = ("bundle",)) -> DataFrame:
    """(group..., n, <prefix>intercept, <prefix>beta_...): least squares, or a ridge, in each group."""
    names = names_of(cov, prefix)
    g = gram(with_design(df, cov), cov.size, by)
    return solve(with_ridge(g, cov.size, ridge) if ridge else g, cov.size, names)


def names_of(cov: Covariates, prefix: str = "") -> list[str]:
    return [f"{prefix}{x}" for x in ("intercept", *cov.labels)]
