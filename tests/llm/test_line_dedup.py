import random

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm.line_dedup import dedup, op3_line_dedup

from .odd import SCHEMA, empty, odd, rows_of


def words(line):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    for c in "\t\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return tuple(x for x in lower.split(" ") if x)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(rows, least=8):
    """rows: (doc_id, key, text), by (doc_id, key) with nulls first; equal rows are one document."""
    order = sorted({(-1 if i is None else i, k): t for i, k, t in rows}.items())
    lines = [(at, n, words(x)) for at, t in order for n, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    gone = {(at, n) for k, (at, n, w) in enumerate(lines) if any(near(w, v) for _, _, v in lines[:k] if abs(len(v) - len(w)) < 2)}
    out = []
    for i, k, t in rows:
        at = (-1 if i is None else i, k)
        out.append((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (at, n) not in gone)))
    return sorted(out, key=str)


def keyed(df):
    return [(r["doc_id"], r["key"], r["text"]) for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text").collect()]


def result(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_table(spark, sf):
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows_of(spark, sf)], "doc_id long, text string")
    want = brute(keyed(df))
    got = dedup(df, counts=("e", "n"))
    assert result(got) == want
    lost = sum(len((t or "").split("\n")) for _, _, t in keyed(df)) - sum(len((t or "").split("\n")) for _, t in want)
    assert lost > 0 and got.agg(F.sum(F.col("e") + F.col("n"))).first()[0] >= lost


def test_edits(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(40)}" for _ in range(r.randrange(8, 14))] for _ in range(12)]
    rows = []
    for k in range(80):
        lines = []
        for _ in range(r.randrange(1, 6)):
            x = list(r.choice(base))
            for _ in range(r.randrange(3)):
                at, kind = r.randrange(len(x)), r.randrange(3)
                x[at : at + (kind != 2)] = [] if kind == 0 else [f"w{r.randrange(40)}"]
            lines.append(" ".join(x))
        rows.append((k, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(dedup(df)) == brute(keyed(df))
    assert result(dedup(df, sketch=10)) == brute(keyed(df))


def test_odd(spark):
    df = odd(spark)
    got = dedup(df)
    assert got.columns == df.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert result(got.select("doc_id", "text")) == brute(keyed(df.select("doc_id", "text")))
    assert dedup(empty(spark)).count() == 0


def brute_short(rows, least=8):
    """As ``brute``, and lines of fewer words go if an earlier one is equal."""
    order = sorted({(-1 if i is None else i, k): t for i, k, t in rows}.items())
    seen, gone, long = set(), set(), []
    for at, t in order:
        for n, x in enumerate((t or "").split("\n")):
            w = words(x)
            if w and (w in seen or len(w) >= least and any(near(w, v) for v in long if abs(len(v) - len(w)) < 2)):
                gone.add((at, n))
            seen.add(w)
            long += [w] if len(w) >= least else []
    out = []
    for i, k, t in rows:
        at = (-1 if i is None else i, k)
        out.append((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (at, n) not in gone)))
    return sorted(out, key=str)


def test_short_lines(spark, tmp_path):
    long = "a line of eight words that stands twice"
    rows = [(1, f"Home\nsix words of a page foot\n\nown words one\n{long}"), (2, f"home \nsix words of a  page FOOT\n\nown words two\n{long}\nhome"), (3, "six words of a page head\nHome\nHome"), (4, None), (None, "home")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_short(keyed(df))
    assert (2, "\nown words two") in want and (3, "six words of a page head") in want
    got = op3_line_dedup(spark, str(tmp_path))
    assert result(got) == want and got.agg(F.sum("n_exact")).first()[0] == 7
    assert result(corpus_pipeline.lines(spark, df, str(tmp_path))) == [x for x in want if len((x[1] or "").split()) >= corpus_pipeline.LEAST]


def test_short_lines_of_table(spark, sf):
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows_of(spark, sf)], "doc_id long, text string")
    assert result(op3_line_dedup(spark, sf)) == brute_short(keyed(df))
