"""Line deduplication by deletion neighbourhoods (operator 3).

Lines are sequences of words.  Two lines are alike if they are equal or one word was
changed, added or left out.  Every line that may have such a neighbour emits the hashes
of itself without each of its words; lines that meet on a hash are compared, and a line
goes if an earlier one is alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import materialise, read, unused
from .words import Rolling, WordHashes, in_sketch, signed, sketch_bits

_OCCURRENCES = "doc_id long, key long, line_no int, h long, k1 long, k2 long, k3 long, k4 long"
_HEAD, _TAIL = 1, 2


class _Lines:
    """Hashed lines of texts that have at least ``least`` words, many texts at a time."""

    #: Words after which a group of lines is handed on.
    group = 100_000

    def __init__(self, least: int):
        self.least, self.hashes, self.rolling = least, WordHashes(), Rolling()

    def sums(self, lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums over the words of all lines, the lines' begins, their ends)."""
        n = np.fromiter(map(len, lines), np.int64, len(lines))
        ends = np.cumsum(n)
        return self.rolling.sums(self.hashes.of(list(chain.from_iterable(lines)))), ends - n, ends

    def groups(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of the texts, line numbers, words of the judged lines, sums, begins, ends)."""
        at, no, lines, size = [], [], [], 0
        for k, text in enumerate(texts):
            for j, line in enumerate((text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):
                words = line.split()
                if len(words) >= self.least:
                    at.append(k)
                    no.append(j)
                    lines.append(words)
                    size += len(words)
            if size >= self.group:
                yield at, no, lines, *self.sums(lines)
                at, no, lines, size = [], [], [], 0
        if lines:
            yield at, no, lines, *self.sums(lines)


def _occurrences(least: int, least_near: int):
    """Every line of ``least`` words or more; the keys only where it has ``least_near``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = _Lines(least)
        span = lines.rolling.spans
        for batch in batches:
            for at, no, _, sums, b, e in lines.groups(batch.column(1).to_pylist()):
                n = e - b
                m, m2 = n // 2, (n - 1) // 2
                cols = [span(sums, b, e), span(sums, b, b + m, _HEAD), span(sums, e - m, e, _TAIL), span(sums, b, b + m2, _HEAD), span(sums, e - m2, e, _TAIL)]
                own, h, *keys = pa.array(at), *map(signed, cols)
                keys = [pa.array(k, mask=n < least_near) for k in keys]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), pa.array(no, pa.int32()), pa.array(h), *keys], names=[c.split()[0] for c in _OCCURRENCES.split(", ")])

    return run


def _texts(least: int, wanted, holders):
    """(h, line) of wanted lines, from texts whose key may hold one; the other texts are not taken apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, seen = _Lines(least), set()
        for batch in batches:
            batch = batch.filter(pa.array(in_sketch(holders.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))
            hs, out = [], []
            for _, _, words, sums, b, e in lines.groups(batch.column(0).to_pylist()):
                h = lines.rolling.spans(sums, b, e)
                for k in np.flatnonzero(in_sketch(wanted.value, h)):
                    if (v := int(h[k])) not in seen:
                        if len(seen) < 500_000:
                            seen.add(v)
                        hs.append(v)
                        out.append(b" ".join(words[k]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.asarray(hs, np.uint64))), pa.array(out, pa.binary())], names=["h", "line"])

    return run


def _variants(wanted=None):
    """(v, pos, h) of every line: itself (pos -1) and itself without each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Lines(0)
        for batch in batches:
            for at, words, sums, b, e in _whole_lines(hashed, batch.column(1).to_pylist()):
                line = np.repeat(np.arange(len(words)), e - b)
                v = np.concatenate([hashed.rolling.spans(sums, b, e), hashed.rolling.without_one(sums, b[line], e[line])])
                pos = np.concatenate([np.full(len(words), -1), np.arange(len(line)) - b[line]]).astype(np.int32)
                own = np.asarray(at)[np.concatenate([np.arange(len(words)), line])]
                if wanted is not None:
                    keep = in_sketch(wanted.value, v)
                    v, pos, own = v[keep], pos[keep], own[keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(v)), pa.array(pos), batch.column(0).take(pa.array(own))], names=["v", "pos", "h"])

    return run


def _whole_lines(hashed: _Lines, lines: list[bytes]) -> Iterator[tuple[list[int], list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the lines, their words, sums, begins, ends), some lines at a time."""
    at, words, size = [], [], 0
    for k, line in enumerate(lines):
        at.append(k)
        words.append(line.split(b" "))
        size += len(words[-1])
        if size >= hashed.group:
            yield at, words, *hashed.sums(words)
            at, words, size = [], [], 0
    if words:
        yield at, words, *hashed.sums(words)


def alike(a: bytes, b: bytes) -> bool:
    """Whether two lines are at most one word apart."""
    x, y = sorted((a.split(b" "), b.split(b" ")), key=len)
    if len(y) - len(x) > 1:
        return False
    k = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(x))
    return x[k + (len(x) == len(y)) :] == y[k + 1 :] if k < len(y) else True


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [alike(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], names=["h"])


def near_lines(docs: DataFrame, lines: DataFrame, *, text: str, least: int, bits: int) -> DataFrame:
    """(h): distinct lines of which an earlier one is one word apart.

    ``lines`` has each distinct line's hash ``h``, its first place ``o`` and four keys.
    Lines one word apart agree in their first or their last half, so only lines that
    share a half with another line need to emit variants.
    """
    spark = docs.sparkSession
    keys = lines.select("h", F.col("o.key").alias("key"), F.explode(F.array_distinct(F.array("k1", "k2", "k3", "k4"))).alias("k")).where(F.col("k").isNotNull())
    shared = keys.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where(F.col("a") != F.col("b")).select("k")
    candidates = materialise(keys.join(shared, "k", "left_semi").select("h", "key").distinct(), "line-candidates")
    wanted, holders = (spark.sparkContext.broadcast(sketch_bits(candidates, c, bits)) for c in ("h", "key"))
    texts = materialise(docs.select(F.col(text), _key(text)).mapInArrow(_texts(least, wanted, holders), "h long, line binary").groupBy("h").agg(F.first("line").alias("line")), "line-texts")
    met = texts.mapInArrow(_variants(), "v long, pos int, h long").groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    twice = spark.sparkContext.broadcast(sketch_bits(met, "v", bits))
    variants = texts.mapInArrow(_variants(twice), "v long, pos int, h long")
    r = materialise(variants.join(lines.select("h", "o"), "h"), "line-variants")
    one, whole = r.where(F.col("pos") >= 0), r.where(F.col("pos") < 0)
    first = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct("o", "h")).alias("f")).select(*by, F.col("f.o").alias("first_o"), F.col("f.h").alias("first"))
    pairs = [
        one.join(first(one, "v", "pos"), ["v", "pos"]),  # the same word changed
        one.join(whole.select("v", F.col("o").alias("first_o"), F.col("h").alias("first")), "v"),  # a word more than an earlier line
        whole.join(first(one, "v"), "v"),  # a word less than an earlier line
    ]
    pairs = [p.where(F.col("first_o") < F.col("o")).select("h", "first") for p in pairs]
    met = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()
    both = met.join(texts.select("h", F.col("line").alias("a")), "h").join(texts.select(F.col("h").alias("first"), F.col("line").alias("b")), "first")
    return both.select("h", "a", "b").mapInArrow(_verified, "h long").distinct()


def find(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", min_words: int = 8, exact_words: int | None = None, sketch: int = 26) -> DataFrame:
    """(doc_id, key, drop, n_exact, n_near): for rows with lines to drop, their numbers.  ``key`` is a hash of the text."""
    occ = materialise(docs.select(F.col(doc).cast("long"), F.col(text), _key(text)).mapInArrow(_occurrences(min_words if exact_words is None else min(exact_words, min_words), min_words), _OCCURRENCES), "line-occurrences")
    place = F.struct("doc_id", "key", "line_no")
    agg = occ.groupBy("h").agg(F.min(place).alias("o"), F.count("*").alias("n"), *[F.min(k).alias(k) for k in ("k1", "k2", "k3", "k4")])
    lines = materialise(agg, "lines")
    near = near_lines(docs, lines, text=text, least=min_words, bits=sketch).select("h", F.lit(True).alias("near"))
    judged = lines.join(near, "h", "left").select("h", "o", "n", F.coalesce("near", F.lit(False)).alias("near")).where((F.col("n") > 1) | F.col("near"))
    judged = materialise(judged, "line-judged")  # the join below is then between plain shuffles, so the places of one very common line are split
    each = occ.select("h", "doc_id", "key", "line_no").distinct().join(judged, "h")
    again = ~place.eqNullSafe(F.col("o"))
    drop = each.where(again | F.col("near")).groupBy("doc_id", "key").agg(F.collect_list("line_no").alias("drop"), F.count_if(again).alias("n_exact"), F.count_if(~again & F.col("near")).alias("n_near"))
    return drop


def _without(text: str | None, drop: list[int] | None) -> str | None:
    if not drop:
        return text
    gone = set(drop)
    return "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in gone)


def _rewrite(at: int, names: list[str]):
    """The first columns, with the text at ``at`` rewritten by the last column, the numbers of the lines to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, drop = batch.column(at), batch.column(len(names))
            lose = drop.is_valid()
            new = [_without(t, d) for t, d in zip(text.filter(lose).to_pylist(), drop.filter(lose).to_pylist(), strict=True)]
            text = pc.replace_with_mask(text, lose, pa.array(new, text.type)) if new else text
            yield pa.RecordBatch.from_arrays([text if k == at else batch.column(k) for k in range(len(names))], names=names)

    return run


def _key(text: str):
    """Tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def dedup(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", min_words: int = 8, exact_words: int | None = None, sketch: int = 26, counts: tuple[str, str] | None = None) -> DataFrame:
    """The input rows with repeated lines taken out; ``counts`` names two more columns, the lines each row lost as equal and as near.

    Over all lines of ``min_words`` words or more, in order of (document, hash of its
    text, line number), a line is dropped if any earlier line is equal to it or one word
    apart, whether or not that earlier line is itself dropped.  Case of A-Z and white
    space do not count.  Lines of fewer, but ``exact_words`` words or more, are
    dropped only if an earlier line is equal; with 1 that is every line that is not empty.
    Shorter lines stay.  ``exact_words`` is ``min_words`` if not given.

    The edit bound is one word: a line with two words changed is not near.  A chain of
    lines, each one word from the one before, so leaves its first line only.

    Null text stays null; a null id comes before all others.  Rows that repeat an id and
    a text are one document: they lose the same lines.  Lines of one place in the order
    do not tie, as text hash and line number tell them apart.  Very long texts are taken
    whole, some hundred thousand words at a time.  Empty tables give empty results; other
    columns pass through.
    """
    found = find(docs, text=text, doc=doc, min_words=min_words, exact_words=exact_words, sketch=sketch)
    key, drop = unused(docs, "_key"), unused(docs, "_drop")
    d = docs.withColumn(key, _key(text))
    number = lambda c, name: F.coalesce(found[c], F.lit(0).cast("long")).alias(name)
    more = [number(c, name) for c, name in zip(("n_exact", "n_near"), counts or (), strict=False)]
    j = d.join(found, d[doc].cast("long").eqNullSafe(found["doc_id"]) & (d[key] == found["key"]), "left")
    j = j.select(*[d[f"`{c}`"] for c in docs.columns], *more, found["drop"].alias(drop))
    kept = j.columns[:-1]
    return j.mapInArrow(_rewrite(docs.columns.index(text), kept), j.schema[:-1])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with lines that repeat an earlier line taken out; lines of 8 words or more also if they are one word apart."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, exact_words=1, counts=("n_exact", "n_near"))
