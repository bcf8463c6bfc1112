"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, extra columns with clashing names."""

from pyspark.sql import functions as F

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _key string, _drop int, _n int, key string, h long, line string, topic string, tokens string, "
          "u string, w string, p string, _in string, _shard string, _arrival string, _metadata string, hash string, body string, repo string, base string, host string, basket string, a long, b long, rank int")
EXTRA = ("x",) + (1, 1, "k", 2, "l", "t", "t", "u", "w", "p", "i", "s", "a", "m", "h", "b", "r", "b", "h", "b", 1, 2, 3)

LONG = " ".join(f"word{k % 977} and some{k % 31} token = abcdef{k}" for k in range(6_000))
SAME = "The quick brown fox jumps over the lazy dog near the old river bank today.\nAnother fairly ordinary line of text that says nothing much at all."


def odd_rows():
    rows = [
        (1, SAME, "en", "src0"), (2, SAME, "en", "src0"), (2, SAME, "en", "src0"), (3, None, "en", "src0"), (4, "", None, "src1"), (5, SAME, None, None),
        (None, SAME, "en", "src0"), (None, None, None, None), (6, LONG, "fr", "src1"), (7, "\n\n \t\n", "de", "src1"), (8, "one", "de", ""),
        (2, "a different text under an id that was used before, with more than ten words in it", "en", "src0"), (9, SAME + "\U0001f600 é", "en", "src0"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(spark, sf):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents(spark, sf).select("doc_id", "text", "lang", "source").orderBy(F.col("doc_id")).collect()]
