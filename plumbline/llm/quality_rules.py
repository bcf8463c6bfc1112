"""Quality rules with cross-document line frequency (operator 6)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import materialise, read, unused
from .words import WordHashes, signed, split, windows

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_NOT_TEXT = re.compile(r"[\W\d_]+")
_MEASURED = ("doc_id long, host string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "lines array<long>, line_words array<long>")


def normal_line(line: str) -> str:
    """Lower case; runs of anything but letters become one space."""
    return _NOT_TEXT.sub(" ", line.lower()).strip()


def _repeated(words: list[bytes], hashes: WordHashes) -> int:
    if len(words) < 6:
        return 0
    w = windows(hashes.of(words), 5)
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + 5, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    hashes = WordHashes()
    for batch in batches:
        rows = []
        for doc_id, host, text, key in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = text or ""
            words, seen, dup, lines = split(text), set(), 0, Counter()
            for line in text.split("\n"):
                if n := len(split(line)):
                    dup += line in seen
                    seen.add(line)
                    if normal := normal_line(line):
                        lines[xxhash.xxh3_64_intdigest(normal.encode("utf-8", "surrogatepass"))] += n
            rows.append((doc_id, host, key, len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), dup,
                         _repeated(words, hashes), signed(np.fromiter(lines, np.uint64, len(lines))), list(lines.values())))
        cols = list(zip(*rows, strict=True)) or [()] * 10
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _MEASURED.split(", ")])


def _key(text: str):
    """Tells apart rows that share an id and a host, and equal texts of a host together."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def measure(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", host: str = "source") -> DataFrame:
    """Base figures of each row, and its distinct normalised lines with their words."""
    return docs.select(F.col(doc).cast("long"), F.col(host).cast("string"), F.col(text), _key(text)).mapInArrow(_measure, _MEASURED)


def frequent_lines(measured: DataFrame, *, max_docs: int, max_share: float = 0.0) -> DataFrame:
    """(host, line): lines in more than ``max_docs`` distinct texts of a host and, if a ``max_share`` is given, in more than that share of them.

    Copies of a text count once.  Counts are combined before the shuffle, so a line that
    a third of all documents carry sends one row per task.
    """
    texts = measured.dropDuplicates(["host", "key"])
    n = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    if max_share <= 0:
        return n.select("host", "line")
    size = texts.groupBy("host").agg(F.count("*").alias("n_texts"))
    same = n["host"].eqNullSafe(size["host"])
    return n.join(size, same).where(n["n"] > max_share * size["n_texts"]).select(n["host"], "line")


def judge(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", host: str = "source", max_docs: int = 20, max_share: float = 0.0,
          min_words: int = 10, max_removed: float = 0.5) -> DataFrame:
    """One row per input row: base figures, the lines to remove, and the verdict.

    A line is over-frequent if it is in more than ``max_docs`` documents of its host,
    however large the host; ``max_share`` demands a share of them as well.  Documents of
    one and the same text count once: else a text with many copies would lose all its
    lines, and with them every copy, which is for the duplicate operators to decide.

    Base rules fail a text of under ``min_words`` words, or with over a fifth of its
    words in repeated 5-word windows.  Of the others, a text is depleted, and so
    rejected, if removing its over-frequent lines takes more than ``max_removed`` of
    its words or leaves under ``min_words``.

    Null text is empty text (no words: fails).  A null host is a host of its own.  Very
    long texts are measured whole.  Repeated rows tie: they give repeated results and
    count once.  Empty tables give empty results; extra columns are not read.
    """
    m = materialise(measure(docs, text=text, doc=doc, host=host), "quality-measured")
    often = frequent_lines(m, max_docs=max_docs, max_share=max_share)
    each = m.dropDuplicates(["host", "key"]).select("host", "key", F.explode(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("n"))).alias("x")).select("host", "key", "x.*")
    hit = each.join(often.select(F.col("host").alias("h"), F.col("line").alias("l")), each["host"].eqNullSafe(F.col("h")) & (each["line"] == F.col("l")))
    gone = hit.groupBy(F.col("host").alias("h"), F.col("key").alias("k")).agg(F.sum("n").alias("removed"), F.collect_list("line").alias("drop_lines"))
    out = m.join(gone, m["host"].eqNullSafe(F.col("h")) & (m["key"] == F.col("k")), "left")
    removed = F.coalesce("removed", F.lit(0).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (removed > 0) & ((removed > max_removed * F.col("n_words")) | (F.col("n_words") - removed < min_words))
    return out.select("doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & ~depleted).alias("kept"), removed.alias("n_removed_words"), F.coalesce("drop_lines", F.array().cast("array<long>")).alias("drop_lines"))


def without_lines(text: str | None, drop: list[int]) -> str | None:
    """The text without the lines whose normal form has one of the (signed) hashes."""
    import xxhash

    if not drop:
        return text
    gone = {h % (1 << 64) for h in drop}
    return "\n".join(x for x in (text or "").split("\n") if not (n := normal_line(x)) or xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) not in gone)


def clean(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", host: str = "source", **limits) -> DataFrame:
    """The rows that the rules keep, all their columns, without their over-frequent lines; see ``judge``."""
    v = judge(docs, text=text, doc=doc, host=host, **limits).where("kept").select("doc_id", "host", "key", "drop_lines").dropDuplicates(["doc_id", "host", "key"])
    key, drop = unused(docs, "_key"), unused(docs, "_drop")
    d = docs.withColumn(key, _key(text))
    same = d[doc].cast("long").eqNullSafe(v["doc_id"]) & d[host].cast("string").eqNullSafe(v["host"]) & (d[key] == v["key"])
    j = d.join(v, same).select(*[d[f"`{c}`"] for c in docs.columns], v["drop_lines"].alias(drop))
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [without_lines(t, x) for t, x in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=names)

    return j.mapInArrow(run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdicts of all documents; the source is the host."""
    return judge(read(spark, sf_dir, "documents")).drop("host", "key", "drop_lines")
