"""Exact percentiles of groups of any size.

Values are counted in buckets, and only the buckets that hold a wanted rank are sorted; a
bucket of too many rows is counted again in finer ones.  So no task holds a group's
values.  A row may belong to several groups (age windows): it is counted once in its cell,
the cells' counts make the groups', and only rows of wanted buckets are copied.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a bucket that are sorted in one task, and buckets that a larger one is split into.
MOST, FINER = 100_000, 1024


def _coarse(v: Column) -> Column:
    """A bucket of about half a per cent of the value; it never falls as the value grows.  NaN is above all."""
    size = F.floor(F.log2(F.least(F.abs(v), F.lit(1.7e308))) * 128).cast("long") + 140_800  # above 0 for the smallest double
    return F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def _same(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _at_ranks(spark: SparkSession, rows: DataFrame, problems: dict[int, tuple[int, float, float, list[int]]], most: int) -> dict[tuple[int, int], float]:
    """Values at ranks (from 0) of groups ``g`` of ``rows`` (g, v).  A problem has its group's rows, least and greatest value, and ranks."""
    found: dict[tuple[int, int], float] = {}
    origin = {(g, k): [(g, k)] for g, p in problems.items() for k in p[3]}
    while problems:
        few, many = ({g: p for g, p in problems.items() if (p[0] <= most) == side} for side in (True, False))
        if few:
            want = _table(spark, [(g, k) for g, p in few.items() for k in p[3]], "g long, k long")
            ranked = rows.join(_table(spark, [(g,) for g in few], "g long"), "g").withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("v")).cast("long") - 1)
            for r in ranked.join(want, ["g", "k"]).collect():  # a row a rank
                for o in origin[r["g"], r["k"]]:
                    found[o] = r["v"]
        if not many:
            return found
        span = _table(spark, [(g, lo, hi) for g, (_, lo, hi, _) in many.items()], "g long, lo double, hi double")
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: a range may be wider than a double
        split = rows.join(span, "g").withColumn("bucket", F.least(F.lit(FINER - 1), F.floor(share * FINER)).cast("long"))
        counts = split.groupBy("g", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        want = _table(spark, [(g, k) for g, p in many.items() for k in p[3]], "g long, k long")
        hit = counts.withColumn("before", before).join(want, "g").where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n"))).collect()
        problems, ids, following = {}, {}, {}
        for r in hit:
            if _same(r["lo"], r["hi"]):
                for o in origin[r["g"], r["k"]]:
                    found[o] = r["lo"]
                continue
            g = ids.setdefault((r["g"], r["bucket"]), len(ids))
            k = r["k"] - r["before"]
            problems.setdefault(g, (r["n"], r["lo"], r["hi"], []))[3].append(k)
            following.setdefault((g, k), []).extend(origin[r["g"], r["k"]])
        origin = following
        if ids:
            rows = split.join(_table(spark, [(*k, g) for k, g in ids.items()], "g long, bucket long, g2 long"), ["g", "bucket"]).select(F.col("g2").alias("g"), "v")
    return found


def percentiles(df: DataFrame, by: Sequence[str], wanted: Sequence[float], *, value: str = "mean", groups: DataFrame | None = None, cell: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """(by..., percentile, value): interpolated between neighbours; nulls do not count.

    With ``groups``, its rows say which groups (``by``) the rows of a ``cell`` belong to:
    both share the columns of ``cell``.  The result is a row a group and percentile; it is
    settled now, as the passes before it are.
    """
    from .models import kept

    by, cell, spark = list(by), list(cell or by), df.sparkSession
    wanted = [float(p) for p in wanted]
    # own names inside, so that no column of the caller's clashes
    of_cell = [f"q{k}" for k in range(len(cell))]
    of_group = of_cell if groups is None else [f"k{k}" for k in range(len(by))]
    schema = {f.name: f.dataType.simpleString() for f in (df if groups is None else groups).schema.fields}
    kinds = ", ".join(f"{name} {schema[c]}" for name, c in zip(of_group, by, strict=True))
    links = None if groups is None else groups.select(*[F.col(c).alias(q) for c, q in zip(cell, of_cell, strict=True)], *[F.col(c).alias(k) for c, k in zip(by, of_group, strict=True)])
    with kept(df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(q) for c, q in zip(cell, of_cell, strict=True)], F.col(value).cast("double").alias("v")).withColumn("bucket", _coarse(F.col("v")))) as rows:
        counts = rows.groupBy(*of_cell, "bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        if links is not None:
            counts = counts.join(links, of_cell).groupBy(*of_group, "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        order = Window.partitionBy(*of_group).orderBy("bucket")
        counts = counts.withColumns({"before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*of_group))})
        place = [F.lit(p) * (F.col("total") - 1) for p in wanted]
        ranks = F.array(*[F.struct(F.lit(k).alias("p"), F.lit(side).alias("side"), f(x).cast("long").alias("k")) for k, x in enumerate(place) for side, f in enumerate((F.floor, F.ceil))])
        here = F.filter(ranks, lambda r: (r["k"] >= F.col("before")) & (r["k"] < F.col("before") + F.col("n")))
        hit = counts.select(*of_group, "bucket", "n", "lo", "hi", "before", "total", F.explode(here).alias("r")).select("*", "r.*").drop("r").collect()  # two rows a group and percentile
        ids, problems, known, totals = {}, {}, {}, {}
        for r in hit:
            key = tuple(r[c] for c in of_group)
            totals[key] = r["total"]
            at = r["k"] - r["before"]
            if _same(r["lo"], r["hi"]):
                known[key, r["p"], r["side"]] = r["lo"]
                continue
            g = ids.setdefault((key, r["bucket"]), len(ids))
            problem = problems.setdefault(g, (r["n"], r["lo"], r["hi"], []))
            if at not in problem[3]:
                problem[3].append(at)
            known[key, r["p"], r["side"]] = (g, at)
        if problems:
            wants = _table(spark, [(*key, bucket, g) for (key, bucket), g in ids.items()], f"{kinds}, bucket long, g long")
            near = rows.join(wants, [*of_cell, "bucket"]) if links is None else rows.join(wants.join(links, of_group).select(*of_cell, "bucket", "g"), [*of_cell, "bucket"])
            found = _at_ranks(spark, near.select("g", "v"), problems, most)
        out = []
        value_of = lambda x: found[x] if isinstance(x, tuple) else x
        for key, total in totals.items():
            for k, p in enumerate(wanted):
                low, high, x = value_of(known[key, k, 0]), value_of(known[key, k, 1]), p * (total - 1)
                out.append((*key, p, low if _same(low, high) else (math.ceil(x) - x) * low + (x - math.floor(x)) * high))
        return _table(spark, out, f"{kinds}, percentile double, value double").withColumnsRenamed(dict(zip(of_group, by, strict=True)))


def wide(p: DataFrame, by: Sequence[str], columns: dict[str, float]) -> DataFrame:
    """One row a group, with a column for each named percentile."""
    return p.groupBy(*by).agg(*[F.max(F.when(F.col("percentile") == F.lit(float(x)), F.col("value"))).alias(c) for c, x in columns.items()])
