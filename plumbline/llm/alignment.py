"""Alignment of two tokenizers' tokens (operator 13).

Both tokenizers cut a text before a single space between two words, so a text is a row of
pieces that are aligned each by itself.  A task keeps DuckDB tables: of the pieces that it
has not met before, the tokens of both kinds as byte intervals on one axis.  A range join
gives the overlaps, common ends are numbered by a window sum, as-of joins find the group
and the piece of each token.  Texts then add up their pieces.  Pair counts of each group
of texts are merged in Spark; the most frequent pairs go back to the tasks as one bounded
table, the others meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import _LONG_BLANK, BLANKS, _ranks
from .support import materialise, read

#: Characters of texts that are aligned together, and of pieces that one join takes; pieces, and their characters, that a task remembers.
GROUP, SLAB, PIECES, PIECE_CHARS = 2_000_000, 1_000_000, 200_000, 20_000_000
#: The most frequent pairs, which tasks look up by themselves.
LOCAL_PAIRS = 1 << 19
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
_BLANK = "▁"


class Tokens:
    """Ids of both tokenizers, and the bytes that each id stands for."""

    def __init__(self, a_file: str, b_file: str, pattern: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        ranks = _ranks(a_file)
        if ranks is None:
            raise ValueError("the first tokenizer must be plain byte-level BPE")
        self.whole = Tokenizer.from_file(a_file)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fast = tiktoken.Encoding("align", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b_model = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.a_bytes[k] = token
        m, names = self.b_model, range(self.b_model.get_piece_size())
        pieces = [m.id_to_piece(k) for k in names]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(k) else p.replace(_BLANK, " ").encode() for k, p in zip(names, pieces, strict=True)]
        #: Whether no token spans the place before a space that follows another character.
        self.splits = not any(_BLANK in p.lstrip(_BLANK) for p in pieces) and pattern == _pattern()

    def a(self, text: str) -> list[int]:
        # the faster engine cannot take blanks without end
        return self.whole.encode(text, add_special_tokens=False).ids if len(text) > BLANKS and _LONG_BLANK.search(text) else self.fast.encode_ordinary(text)

    def b(self, text: str) -> list[int]:
        """Of a text that begins with the space which the model adds."""
        return self.b_model.encode(text[1:], num_threads=1)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pieces_of(text: str, splits: bool = True) -> list[str]:
    """Pieces of a text; each is preceded by one space."""
    return _BETWEEN_WORDS.split(text) if splits else [text]


def _table(ids: list[int], of: list[bytes], begin: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, map(of.__getitem__, ids)), np.int64, len(ids))
    return np.asarray(ids, np.int64), begin + np.cumsum(size)


class Aligner:
    """Aligned pieces of a task, and sums over them for texts."""

    def __init__(self, tokens: Tokens):
        import duckdb

        self.t, self.con = tokens, duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "700MB"})
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.chars, self.groups = 0, []  # the groups of each piece as text
        self.sums = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether bytes are lost
        self.con.execute("CREATE OR REPLACE TEMP TABLE pairs (piece INT, pair BIGINT, n BIGINT)")

    def _intervals(self, pieces: list[str]):
        """Token intervals of pieces on one axis, (piece, begin, end) of those that keep their bytes, and which do not."""
        bodies = [f" {p}" for p in pieces]
        plain = [not (b[1:2].isspace() or b[-1:].isspace()) and self.t.splits for b in bodies]
        parts_a, parts_b, spans, lost, at = [], [], [], [], 0

        def add(members: list[int]) -> None:
            nonlocal at
            text = "".join(bodies[k] for k in members)
            raw, a, b = text.encode(), self.t.a(text), self.t.b(text)
            if b"".join(map(self.t.b_bytes.__getitem__, b)) != raw or b"".join(map(self.t.a_bytes.__getitem__, a)) != raw:
                if len(members) == 1:
                    lost.append(members[0])
                else:
                    for k in members:
                        add([k])
                return
            size = [len(bodies[k].encode()) for k in members]
            ends = at + np.cumsum(size)
            parts_a.append(_table(a, self.t.a_bytes, at))
            parts_b.append(_table(b, self.t.b_bytes, at))
            spans.append((np.asarray(members), ends - size, ends))
            at += len(raw)

        add_all = [k for k, p in enumerate(plain) if p]
        for k in range(0, len(add_all), 20_000):
            add(add_all[k : k + 20_000])
        for k, p in enumerate(plain):
            if not p:
                add([k])
        return parts_a, parts_b, spans, lost

    def _register(self, name: str, **columns) -> None:
        self.con.register(name, pa.table(columns))

    def learn(self, pieces: list[str]) -> None:
        """Aligns pieces that have not been met."""
        first = len(self.groups)
        self.code.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.chars += sum(map(len, pieces))
        parts_a, parts_b, spans, lost = self._intervals(pieces)
        sums, texts = np.zeros((len(pieces), 5), np.int64), [b""] * len(pieces)
        sums[lost, 4] = 1
        if spans:
            for name, parts in (("a", parts_a), ("b", parts_b)):
                ids, ends = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                self._register(name, i=np.arange(len(ids)), id=ids, s=np.append(0, ends[:-1]), e=ends)
            members, s, e = (np.concatenate([x[k] for x in spans]) for k in range(3))
            self._register("spans", piece=members, s=s, e=e)
            run = self.con.execute
            run("CREATE OR REPLACE TEMP TABLE cuts AS SELECT e, sum(1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING)::BIGINT AS g FROM (SELECT e FROM a SEMI JOIN b USING (e))")
            run("CREATE OR REPLACE TEMP TABLE links AS SELECT p.piece, l.pair FROM (SELECT a.s, (a.id << 32) | b.id AS pair FROM a JOIN b ON a.s < b.e AND b.s < a.e) l ASOF JOIN spans p ON l.s >= p.s")
            run(f"INSERT INTO pairs SELECT piece + {first}, pair, count(*) FROM links GROUP BY ALL")
            got = run("SELECT piece, count(*) AS n FROM links GROUP BY piece").fetchnumpy()
            sums[got["piece"], 3] = got["n"]
            each = " UNION ALL ".join(f"SELECT {side} AS side, x.i, x.id, x.e = c.e AS last, c.g, c.e FROM {t} x ASOF JOIN cuts c ON x.e <= c.e" for side, t in enumerate("ab"))
            got = run(f"SELECT t.id, 2 * t.side + t.last::INT AS form, p.piece FROM ({each}) t ASOF JOIN spans p ON t.e <= p.e ORDER BY t.g, t.side, t.i").fetchnumpy()
            for column, mine in enumerate((got["form"] < 2, got["form"] >= 2, got["form"] == 3)):
                sums[:, column] = np.bincount(got["piece"][mine], minlength=len(pieces))
            ends = (b",", b"|", b",", b";")  # within and at the end of a group's first and second part
            said = [b"%d%s" % (i, ends[f]) for i, f in zip(got["id"].tolist(), got["form"].tolist(), strict=True)]
            cuts = np.append(np.flatnonzero(np.diff(got["piece"], prepend=-1)), len(said)).tolist()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                texts[got["piece"][lo]] = b"".join(said[lo:hi])[:-1]
        self.sums = np.concatenate([self.sums, sums])
        self.groups += texts

    def group(self, texts: list[str | None]):
        """Of texts: a row of sums each, the groups' hash, and (text, pair, times) in the texts' order; then (pair, times) of all."""
        if len(self.code) > PIECES or self.chars > PIECE_CHARS:
            self.forget()
        parts = [pieces_of(t, self.t.splits) if t else [] for t in texts]
        new: dict[str, None] = {}
        for p in parts:
            new.update(dict.fromkeys(filterfalse(self.code.__contains__, p)))
        slab, held = [], 0
        for p in new:
            slab.append(p)
            held += len(p)
            if held >= SLAB:
                self.learn(slab)
                slab, held = [], 0
        if slab:
            self.learn(slab)
        codes = [np.fromiter(map(self.code.get, p, repeat(-1)), np.int64, len(p)) for p in parts]
        sums, hashes, kept = np.zeros((len(texts), 4), np.int64), [""] * len(texts), []
        for k, c in enumerate(codes):
            if len(c):
                s = self.sums[c].sum(0)
                if not s[4]:
                    sums[k], hashes[k] = s[:4], hashlib.sha256(b";".join(map(self.groups.__getitem__, c.tolist()))).hexdigest()
                    kept.append(k)
        self._register("occ", text=np.repeat(np.asarray(kept, np.int64), [len(codes[k]) for k in kept]), piece=np.concatenate([codes[k] for k in kept] or [np.zeros(0, np.int64)]))
        self.con.execute("CREATE OR REPLACE TEMP TABLE found AS SELECT text, pair, sum(o.n * p.n)::BIGINT AS n FROM (SELECT text, piece, count(*) AS n FROM occ GROUP BY ALL) o JOIN pairs p USING (piece) GROUP BY text, pair")
        each = self.con.execute("SELECT text, pair, n FROM found ORDER BY text").fetchnumpy()
        total = self.con.execute("SELECT pair, sum(n)::BIGINT AS n FROM found GROUP BY pair").fetchnumpy()
        return sums, hashes, each, total


_ALIGNED = "kind int, key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>, pair long, n long"
_KINDS = [pa.int32(), *[pa.int64()] * 6, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]


def _batch(rows: int, **columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in _ALIGNED.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(rows, kind)) for name, kind in zip(names, _KINDS, strict=True)], names=names)


def _align(a_file: str, b_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(Tokens(a_file, b_file, pattern))
            keys, docs, column, begin = batch.column(0), batch.column(1), batch.column(2), 0
            while begin < batch.num_rows:
                texts, held = [], 0
                while begin + len(texts) < batch.num_rows and held < GROUP:
                    texts.append(column[begin + len(texts)].as_py())
                    held += len(texts[-1] or "")
                n = len(texts)
                sums, hashes, each, total = aligner.group(texts)
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(each["text"], minlength=n))), pa.int32())
                yield _batch(n, kind=pa.array(np.zeros(n, np.int32)), key=keys.slice(begin, n), doc_id=docs.slice(begin, n), **{c: pa.array(sums[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                             groups_sha256=pa.array(hashes), pairs=pa.ListArray.from_arrays(offsets, pa.array(each["pair"])), times=pa.ListArray.from_arrays(offsets, pa.array(each["n"])))
                yield _batch(len(total["n"]), kind=pa.array(np.ones(len(total["n"]), np.int32)), pair=pa.array(total["pair"]), n=pa.array(total["n"]))
                begin += n

    return run


_SUMMED = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, total long, rare array<struct<pair:long,n:long>>"


def _sum_known(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """Sums over a text's pairs that are in a sorted table; the others are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pair, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (7, 8))
            row = np.repeat(np.arange(n), batch.column(7).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            out = np.zeros((2, n), np.int64)
            np.add.at(out[0], row[known], times[known] * best[at[known]])
            np.add.at(out[1], row[known], times[known] * counts[at[known]])
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row[~known], minlength=n))), pa.int32())
            rare = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(pair[~known]), pa.array(times[~known])], ["pair", "n"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(out[0]), pa.array(out[1]), rare], names=[x.split()[0] for x in _SUMMED.split(", ")[:9]] + ["rare"])

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair in the corpus, and 1 where no pair of the second id has more.  The first id is the pair's upper 32 bits."""
    counts = materialise(aligned.where("kind = 1").groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = counts.groupBy(second.alias("b")).agg(F.max("n").alias("most"))  # at most a row an id of the vocabulary
    return counts.withColumn("b", second).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def align(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", a_file: str | None = None, b_file: str | None = None, pattern: str | None = None, local_pairs: int = LOCAL_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(a row a text, a row a pair of ids).

    Of each text: tokens of both tokenizers, groups between common ends, overlapping
    pairs of tokens, how many of these are of the best pair of their second id, the sum
    of their pairs' counts, and a hash of the groups.  Null and empty texts, and texts
    whose tokens do not give back their bytes, have zeros and an empty hash, and count for
    no pair.  Rows that repeat each count; a null id is kept.  Texts of any length are
    taken whole, in memory in proportion to their length.  Ties between pairs all count
    as best.  Empty tables give empty results; extra columns are not read.
    """
    import public_tokenizers

    files = a_file or public_tokenizers.path("byte_bpe_50k.json"), b_file or public_tokenizers.path("piece_bpe_32k.model"), pattern or public_tokenizers.PATTERN
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    aligned = materialise(rows.mapInArrow(_align(*files), _ALIGNED), "aligned")
    counts = materialise(pair_counts(aligned), "align-pairs")
    known = counts.orderBy(F.desc("n"), "pair").limit(local_pairs).toArrow().sort_by("pair")  # a bounded number
    table = [known.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best")]
    columns = [x.split()[0] for x in _SUMMED.split(", ")[:7]]
    summed = materialise(aligned.where("kind = 0").select(*columns, "pairs", "times").mapInArrow(_sum_known(*table), _SUMMED), "align-sums")
    # a pair that no task looks up is rare in the whole corpus, so none is a hot key
    rare = summed.select("key", F.explode("rare").alias("x")).select("key", "x.pair", F.col("x.n").alias("times")).join(counts, "pair")
    more = rare.groupBy("key").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_total"))
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).cast("long")
    each = summed.join(more, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("best", "more_best").alias("n_best"), plus("total", "more_total").alias("count_sum"), "groups_sha256")
    return each, counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "n", (F.col("best") == 1).alias("best"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens under two vocabularies, aligned."""
    return align(read(spark, sf_dir, "documents"))[0]
