"""Mixing sources to target weights by iterative proportional fitting (operator 9)."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import discard, materialise, read

#: The topic where the caller names none: what a text is, told by its form; fixed rules, in order.
TOPIC_SQL = ("CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN text LIKE '%icense%' THEN 'legal' WHEN text LIKE '%@%' THEN 'contact' "
             "WHEN text LIKE '% | %' THEN 'table' ELSE 'prose' END")
DIMENSIONS = ("source", "lang", "topic")
BUDGET, TEMPER, TOLERANCE, ROUNDS = 0.7, 0.5, 1e-12, 60
#: Sweeps over all dimensions between two writes.
SWEEPS = 3


def _uniform() -> Column:
    """A uniform number fixed by the row's id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _topic(topic: Column | None) -> Column:
    return F.expr(TOPIC_SQL) if topic is None else topic


def with_tokens(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, u) of each row."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", "lang", _topic(topic).alias("topic"), tokens.alias("tokens"), _uniform().alias("u"))


def cells_of(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    return rows.groupBy(*dimensions).agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > 0)


def with_targets(cells: DataFrame, dimensions: Sequence[str], targets: Mapping[str, Mapping[str, float]] | None, temper: float) -> DataFrame:
    """A target share of each cell's category in every dimension, and the cell's weight to start with.

    Where no targets are given, a category's share is its token share to the power
    ``temper``, scaled to a sum of 1.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for d in dimensions:
        if targets and d in targets:
            given = F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv])
            out = out.withColumn(f"to_{d}", F.coalesce(given[F.col(d)], F.lit(0.0)))
            continue
        share = out.groupBy(F.col(d).alias("c")).agg(F.sum("tokens").alias("t")).select("c", F.pow(F.col("t") / F.lit(float(total)), temper).alias("s"))
        norm = share.agg(F.sum("s")).first()[0] or 1.0
        out = out.join(share.select("c", (F.col("s") / F.lit(norm)).alias(f"to_{d}")), F.col(d).eqNullSafe(F.col("c"))).drop("c")
    return out


def rake(cells: DataFrame, dimensions: Sequence[str], *, tolerance: float, rounds: int) -> DataFrame:
    """Scale the weights to each dimension's targets in turn until all marginals fit; ``gap`` is the largest difference that is left.

    Only cells are shuffled: there are as many as combinations of categories, however
    many rows the corpus has.  Every few sweeps are written, so their lineage stays short.
    Targets that no weights can meet, as of a language that one source alone has, leave a
    gap after ``rounds`` sweeps: then a warning says so, and the dimension scaled last fits.
    """
    off, worst = F.lit(0.0), None
    for d in dimensions:
        off = F.greatest(off, F.abs(F.sum("w").over(Window.partitionBy(d)) - F.col(f"to_{d}")))
    for _ in range(0, rounds, SWEEPS):
        for d in SWEEPS * tuple(dimensions):
            cells = cells.withColumn("w", F.col("w") * F.col(f"to_{d}") / F.sum("w").over(Window.partitionBy(d)))
        cells = materialise(cells, "raked")
        worst = cells.select(off.alias("off")).agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    if worst and worst > tolerance:
        warnings.warn(f"raking left a gap of {worst:.3g} after {rounds} sweeps", stacklevel=2)
    return cells.withColumn("gap", F.lit(worst or 0.0))


def calibrated(cells: DataFrame, budget: float) -> Column:
    """The probability of a cell's documents: ``w`` over its tokens, scaled so that ``budget`` of all tokens are expected.

    Cells whose probability would pass 1 are taken whole and the rest is scaled up; each
    turn fixes at least one more cell, and two numbers come back to the driver.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale, rate, taken = 0.0, F.col("w") / F.col("tokens"), -1
    while total:
        full = rate * scale >= 1
        n, whole, open_w = cells.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if n == taken or open_w <= 0:
            break
        taken, scale = n, max(scale, (budget * total - whole) / open_w)
    return F.least(F.lit(1.0), rate * scale)


def probabilities(rows: DataFrame, *, budget: float, targets: Mapping[str, Mapping[str, float]] | None, temper: float, dimensions: Sequence[str]) -> DataFrame:
    """(c_<dimension>..., w, p, gap): raked weight and probability of each cell, and what is left of the marginals' differences."""
    cells = rake(with_targets(materialise(cells_of(rows, dimensions), "mix-cells"), dimensions, targets, temper), dimensions, tolerance=TOLERANCE, rounds=ROUNDS)
    return materialise(cells.select(*[F.col(d).alias(f"c_{d}") for d in dimensions], "w", "gap", calibrated(cells, budget).alias("p")), "mix-probabilities")


def _chance() -> Column:
    return F.when(F.col("tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(F.lit(0.0))


def mix(docs: DataFrame, *, budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, dimensions: Sequence[str] = DIMENSIONS,
        topic: Column | None = None) -> DataFrame:
    """One row per input row: its cell, tokens, probability, and whether it is sampled.

    Weights are raked to the marginals of all ``dimensions``; a row is sampled if the
    uniform number of its id is below its probability, so a run repeats exactly and
    repeated rows share one fate.  ``topic`` is a column of ``docs``; without one, the
    form of the text decides.  ``gap`` is the largest difference between a marginal and
    its target that is left.

    A null category is a category.  Rows without tokens weigh nothing and are not
    sampled.  Very long texts are counted whole.  Empty tables give empty results; extra
    columns are not read.
    """
    rows = materialise(with_tokens(docs, topic), "mix-rows")
    p = probabilities(rows, budget=budget, targets=targets, temper=temper, dimensions=dimensions)
    out = rows.join(p, [rows[d].eqNullSafe(p[f"c_{d}"]) for d in dimensions], "left")
    return out.select("doc_id", *dimensions, "tokens", F.coalesce("w", F.lit(0.0)).alias("cell_weight"), _chance().alias("probability"), (F.col("u") < _chance()).alias("sampled"), F.coalesce("gap", F.lit(0.0)).alias("gap"))


def sample(docs: DataFrame, *, budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, dimensions: Sequence[str] = DIMENSIONS,
           topic: Column | None = None) -> DataFrame:
    """The sampled rows with all their columns; see ``mix``.  Tokens are counted once; the second pass only asks whether there are any."""
    rows = materialise(with_tokens(docs, topic), "mix-rows")
    p = probabilities(rows, budget=budget, targets=targets, temper=temper, dimensions=dimensions)
    discard(rows)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in")
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).cast("long")
    d = docs.select(own, "source", "lang", _topic(topic).alias("topic"), some.alias("tokens"), _uniform().alias("u"))
    out = d.join(p, [d[x].eqNullSafe(p[f"c_{x}"]) for x in dimensions])
    return out.where(F.col("u") < _chance()).select("_in.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their sampling probability under raked weights."""
    return mix(read(spark, sf_dir, "documents")).withColumns({"cell_weight": F.round("cell_weight", 9), "probability": F.round("probability", 9), "gap": F.round("gap", 6)})


def op9_sql(rounds: int = ROUNDS) -> str:
    """The same in SQL: all rounds are unrolled (further rounds than needed change nothing), the scale is the closed form."""
    ctes = [
        "r AS (SELECT doc_id, source, lang, " + TOPIC_SQL + " AS topic, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens, "
        "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM documents)",
        "c AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM r GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for d in DIMENSIONS:
        ctes.append(f"t_{d} AS (SELECT {d}, s / sum(s) OVER () AS target FROM (SELECT {d}, pow(sum(tokens)::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM c), {TEMPER}::DOUBLE) AS s FROM c GROUP BY {d}))")
    joins = " ".join(f"JOIN t_{d} ON c.{d} IS NOT DISTINCT FROM t_{d}.{d}" for d in DIMENSIONS)
    ctes.append("w0 AS MATERIALIZED (SELECT c.*, " + ", ".join(f"t_{d}.target AS to_{d}" for d in DIMENSIONS) + f", c.tokens::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM c) AS w FROM c {joins})")
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * to_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM w{k})")
            k += 1
    ctes.append(f"o AS (SELECT *, coalesce(sum(tokens) OVER b, 0) AS whole, sum(w) OVER a AS open_w FROM w{k} WINDOW b AS (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
    ctes.append(f"s AS (SELECT max(({BUDGET}::DOUBLE * (SELECT sum(tokens)::DOUBLE FROM c) - whole) / open_w) AS scale FROM o)")
    off = ", ".join(f"abs(sum(w) OVER (PARTITION BY {d}) - to_{d})" for d in DIMENSIONS)
    ctes.append(f"g AS (SELECT max(off) AS gap FROM (SELECT greatest({off}) AS off FROM w{k}))")
    return ("WITH " + ", ".join(ctes) + " SELECT r.doc_id, r.source, r.lang, r.topic, r.tokens, round(coalesce(o.w, 0.0::DOUBLE), 9) AS cell_weight, "
            "round(CASE WHEN r.tokens > 0 THEN least(1.0::DOUBLE, o.w / o.tokens * s.scale) ELSE 0.0::DOUBLE END, 9) AS probability, "
            "r.tokens > 0 AND r.u < least(1.0::DOUBLE, o.w / o.tokens * s.scale) AS sampled, CASE WHEN o.w IS NULL THEN 0.0::DOUBLE ELSE round(g.gap, 6) END AS gap FROM r CROSS JOIN s CROSS JOIN g LEFT JOIN o ON r.source IS NOT DISTINCT FROM o.source AND r.lang IS NOT DISTINCT FROM o.lang AND r.topic IS NOT DISTINCT FROM o.topic")
