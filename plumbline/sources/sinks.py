"""Forms in which results leave: harmonized tables, wide distances, plot data, model text."""

from __future__ import annotations

import ast
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import Clinical, Model, Options, Pairwise
from ..operators.regression import Covariates, names_of


def harmonized_result(df: DataFrame, params: DataFrame, *, method: str, model: str, order: str | None = None) -> DataFrame:
    """The eleven result columns, for rows of the model's bundles; then the ``order`` column, if given."""
    name = model.removesuffix(".csv").removesuffix(".model")
    out = df.drop("harmonization", "model").join(params.select("bundle"), "bundle", "left_semi")
    return out.select("sid", "bundle", "metric", "mean", "site", "age", "sex", "handedness", "disease", F.lit(method).alias("harmonization"), F.lit(name).alias("model"), *[order] * bool(order))


def write_harmonized(result: DataFrame, path: str, *, order: str, overwrite: bool = False) -> None:
    """A harmonized table by bundle and, within it, in the input's order; the ``order`` column itself is not written."""
    write_csv(result, path, overwrite=overwrite, order=("bundle", order), without=(order,))


def write_csv(df: DataFrame, path: str, *, overwrite: bool = False, order: Sequence[str] = ("site", "sid", "bundle"), without: Sequence[str] = ()) -> None:
    """One CSV folder, in order; what is there stays unless ``overwrite``."""
    sorted_rows = df.orderBy(*[c for c in order if c in df.columns]).drop(*without)
    sorted_rows.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("compression", "gzip").csv(path)


def qc_wide(distances: DataFrame, n_subjects: int, bundles: Sequence[str]) -> DataFrame:
    """One row: the subjects counted, and a column a bundle, in the names' order."""
    each = [F.max(F.when(F.col("bundle") == b, F.col("distance"))).alias(b) for b in sorted(bundles)]
    return distances.agg(F.lit(n_subjects).cast("long").alias("HC"), *each)


def plot_json(points: DataFrame, plot_class: str) -> DataFrame:
    """(bundle, metric, plot): each bundle's points, by x, as a JSON text."""
    xy = F.sort_array(F.collect_list(F.struct("x", "y")))
    return points.groupBy("bundle", "metric").agg(xy.alias("xy")).select("bundle", "metric", F.to_json(F.struct(F.lit(plot_class).alias("plot_class"), F.col("xy.x").alias("data_x"), F.col("xy.y").alias("data_y"))).alias("plot"))


def read_plots(spark: SparkSession, text: str) -> DataFrame:
    """(bundle, metric, plot) of a nested JSON text {bundle: {metric: plot}}."""
    nested = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", "map<string,map<string,string>>")).alias("bundle", "m"))
    return nested.select("bundle", F.explode("m").alias("metric", "plot"))


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(df: DataFrame, by: Sequence[str], name: str, value: str, out: str) -> DataFrame:
    """(by..., out): names and JSON values of each group as one JSON object, by name."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col(value).alias("v")))), lambda x: F.concat(_quoted(x["k"]), F.lit(":"), x["v"]))
    return df.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias(out))


def nested_document(plots: DataFrame) -> DataFrame:
    """One row, ``text``: the plots as nested JSON, {bundle: {metric: plot}}."""
    return _object(_object(plots, ["bundle"], "metric", "plot", "metrics"), [], "bundle", "metrics", "text")


def nested_plots(plots: DataFrame) -> str:
    """``nested_document`` as a text."""
    return nested_document(plots).first()["text"]


def plot_documents(plots: DataFrame) -> DataFrame:
    """(bundle, metric, document) of (bundle, metric, plot_group, plot_name, plot): a JSON object of named plots; those of a group are an object under its name."""
    grouped = _object(plots.where(F.col("plot_group").isNotNull()), ["bundle", "metric", "plot_group"], "plot_name", "plot", "v").withColumnRenamed("plot_group", "k")
    alone = plots.where(F.col("plot_group").isNull()).select("bundle", "metric", F.col("plot_name").alias("k"), F.col("plot").alias("v"))
    return _object(grouped.unionByName(alone), ["bundle", "metric"], "k", "v", "document")


def read_plot_documents(documents: DataFrame) -> DataFrame:
    """The plots of ``plot_documents``: an entry with a ``plot_class`` is a plot, any other is a group."""
    entry = F.from_json("value", "map<string,string>")
    top = documents.select("bundle", "metric", F.explode(F.from_json("document", "map<string,string>")).alias("key", "value")).withColumn("entry", entry)
    plot = F.map_contains_key("entry", "plot_class")
    alone = top.where(plot).select("bundle", "metric", F.lit(None).cast("string").alias("plot_group"), F.col("key").alias("plot_name"), F.col("value").alias("plot"))
    return alone.unionByName(top.where(~plot).select("bundle", "metric", F.col("key").alias("plot_group"), F.explode("entry").alias("plot_name", "plot")))


def merge_named_plots(*tables: DataFrame) -> DataFrame:
    """Plots of all tables; of one bundle, metric, group and name the last table's."""
    out = tables[0].withColumn("_t", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("_t", F.lit(k)))
    return out.groupBy("bundle", "metric", "plot_group", "plot_name").agg(F.max_by("plot", "_t").alias("plot"))


def merge_plots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Plots of both; of a bundle and metric in both, the new one."""
    return new.unionByName(old.join(new, ["bundle", "metric"], "left_anti"))


def model_rows(model: Model) -> list[str]:
    c, rest = model.cov, (["ref_std"], ["mov_std", "mov_gamma", "mov_delta"])
    return [*names_of(c, "ref_"), *rest[0], *names_of(c, "mov_"), *rest[1]] if isinstance(model, Clinical) else [*names_of(c), "sigma", "ref_gamma", "ref_delta", "mov_gamma", "mov_delta"]


def model_table(model: Model) -> DataFrame:
    """(n, parameter, bundle, value): the parameters in the text form's order."""
    rows = model_rows(model)
    pairs = F.array(*[F.struct(F.lit(k).alias("n"), F.lit(r).alias("parameter"), F.col(r).alias("value")) for k, r in enumerate(rows)])
    return model.params.select("bundle", F.explode(pairs).alias("x")).select("x.n", "x.parameter", "bundle", "x.value")


def model_text(model: Model, **meta) -> str:
    """A model as text: a header line, the bundles, then a line a parameter."""
    head = {"name": "clinical" if isinstance(model, Clinical) else "pairwise", "ignore_sex_covariate": not model.cov.sex, "ignore_handedness_covariate": not model.cov.handedness, "degree": model.cov.degree,
            "nbr_beta_params": len(model.cov.labels), **{k: v for k, v in model.meta.items() if k not in ("name", "options")}, **meta}
    rows = model.params.orderBy("bundle").collect()  # a row a bundle
    lines = [f"# {head}", ",".join(["bundle_names", *[r["bundle"] for r in rows]])]
    return "\n".join(lines + [",".join([p, *[repr(r[p]) for r in rows]]) for p in model_rows(model)]) + "\n"


def read_model(spark: SparkSession, text: str) -> Model:
    """A model of its text."""
    head, names, *lines = text.rstrip("\n").split("\n")
    meta = ast.literal_eval(head[2:])
    cov = Covariates(int(meta["degree"]), not meta["ignore_sex_covariate"], not meta["ignore_handedness_covariate"])
    kind = {"clinical": Clinical, "pairwise": Pairwise}.get(meta["name"])
    if kind is None:
        raise ValueError(f"unknown method {meta['name']}")
    values = [x.split(",") for x in lines]
    want = model_rows(kind(None, cov))
    # older files name the standard rows alike but for the coefficients' prefix
    by_row = dict(zip(want, ([float(v) for v in x[1:]] for x in values), strict=True))
    bundles = names.split(",")[1:]
    rows = [(b, *[by_row[p][k] for p in want]) for k, b in enumerate(bundles)]
    return kind(spark.createDataFrame(rows, ", ".join(["bundle string", *[f"`{p}` double" for p in want]])), cov, meta)


__all__ = ["Options", "nested_plots", "read_plots", "harmonized_result", "merge_named_plots", "merge_plots", "nested_document", "plot_documents", "read_plot_documents", "model_table", "model_text", "plot_json", "qc_wide", "read_model", "write_csv", "write_harmonized"]
