"""Best-fit packing by exact-complement hashing (operator 10).

Texts become token pieces in one pass.  Which lengths share a sequence is decided on
the histogram of lengths alone (at most ``size`` counters, whatever the corpus), and
every piece then finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import materialise, read

END = 0  # the id after each document
#: Blanks in a row from which on a text goes through the tokenizer itself.
BLANKS = 10_000
_LONG_BLANK = re.compile(rf"(?<!\s)\s{{{BLANKS}}}")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(tokenizer_file: str) -> dict[bytes, int] | None:
    """Bytes of each token to its id, if the file is plain byte-level BPE whose ids follow the order of its merges; else None."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or spec.get("normalizer") or spec.get("post_processor") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    letter, vocab = _byte_letters(), model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [vocab["".join(m)] for m in merges]
    added = {x["content"] for x in spec.get("added_tokens", [])}
    singles = [vocab[c] for c in letter if c in vocab]
    if len(singles) < 256 or order != sorted(order) or (order and max(singles) > order[0]):
        return None
    return {bytes(letter[c] for c in token): k for token, k in vocab.items() if token not in added}


class Encoder:
    """Ids (little-endian unsigned 32-bit) of whole texts.

    The tokenizer file's merges run in an engine that keeps no offsets or masks, which
    takes a quarter of the time.  Texts that hold a special token's string or blanks
    without end, which that engine cannot take, and files of another kind go through the
    tokenizer itself; both give the same ids.
    """

    def __init__(self, tokenizer_file: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks := _ranks(tokenizer_file):
            import tiktoken

            self.fast = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or (len(text) > BLANKS and _LONG_BLANK.search(text)):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast(text), "<u4")


def pieces_of(ids: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces, its end id included; only the first may be shorter than ``size``."""
    raw, n = np.append(ids, np.uint32(END)).astype("<u4").tobytes(), len(ids) + 1
    first = n if n <= size else (n % size or size)
    cuts = [0, *range(first, n, size), n]
    return [(a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def cut_pieces(docs: DataFrame, *, text: str, doc: str, size: int, tokenizer_file: str, pattern: str) -> DataFrame:
    """All pieces, each with its rank among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, seen, task = Encoder(tokenizer_file, pattern), Counter(), TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (start, length, crc) in enumerate(pieces_of(encode(body or ""), size)):
                    rows.append((doc_id, k, start, length, crc, task, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(run, _PIECES)


class Plan:
    """Patterns of lengths that share a sequence, found under availability counts.

    The index has, for every sum up to ``size``, whether a single length, how many pairs
    and (through the pairs) which triples of available lengths make it.  It is kept up to
    date as lengths are taken, so a look-up never finds what is used up.  There are at
    most ``size`` counters of each kind, whatever the corpus.
    """

    def __init__(self, available: np.ndarray, size: int):
        self.left, self.size = np.zeros(size + 1, np.int64), size
        self.have, self.pairs = np.zeros(size + 1, bool), np.zeros(size + 1, np.int64)
        self.patterns: list[tuple[list[int], int]] = []
        for length in np.flatnonzero(available[1:]) + 1:
            self._set(int(length), int(available[length]))
        for length in range(size, 0, -1):  # first what fills a sequence exactly
            while self.left[length] and (rest := self._with([length], self.complement)) is not None:
                self._emit([length, *rest])
        for length in range(size, 0, -1):  # then the residuals by best fit
            while self.left[length]:
                self._emit(self._best_fit(length))

    def _set(self, x: int, n: int) -> None:
        """Length ``x`` is now available ``n`` times; pair sums follow."""
        was, self.left[x] = int(self.left[x]), n
        if (was > 0) != (n > 0):
            self.have[x] = False
            self.pairs[x + 1 :][self.have[1 : self.size - x + 1]] += 1 if n else -1
            self.have[x] = n > 0
        if 2 * x <= self.size and (was > 1) != (n > 1):
            self.pairs[2 * x] += 1 if n > 1 else -1

    def _with(self, taken: list[int], look: Callable[[int], list[int] | None]) -> list[int] | None:
        """What ``look`` finds for the gap that ``taken`` leaves, while ``taken`` is not available."""
        for x in taken:
            self._set(x, int(self.left[x]) - 1)
        found = look(self.size - sum(taken))
        for x in taken:
            self._set(x, int(self.left[x]) + 1)
        return found

    def complement(self, gap: int) -> list[int] | None:
        """One, two or three available lengths whose sum is exactly ``gap``, the largest length first; [] if there is no gap."""
        if gap <= 0:
            return []
        if self.have[gap]:
            return [gap]
        if self.pairs[gap]:
            return self._pair(gap)
        for a in np.flatnonzero(self.have[1:gap] & (self.pairs[gap - 1 : 0 : -1] > 0))[::-1] + 1:
            self._set(int(a), int(self.left[a]) - 1)
            pair = self._pair(gap - int(a)) if self.pairs[gap - a] else None
            self._set(int(a), int(self.left[a]) + 1)
            if pair:
                return [int(a), *pair]
        return None

    def _pair(self, total: int) -> list[int]:
        a = np.arange((total + 1) // 2, total)
        ok = self.have[a] & (self.left[total - a] > (2 * a == total))
        first = int(a[np.flatnonzero(ok)[-1]])
        return [first, total - first]

    def _best_fit(self, length: int) -> list[int]:
        taken = [length]
        while sum(taken) < self.size:
            if rest := self._with(taken, self.complement):
                return taken + rest
            largest = self._with(taken, lambda gap: [int(x) + 1 for x in np.flatnonzero(self.have[1 : gap + 1])[-1:]])
            if not largest:
                break
            taken += largest
        return taken

    def _emit(self, lengths: list[int]) -> None:
        need = Counter(lengths)
        copies = int(min(self.left[x] // n for x, n in need.items()))
        for x, n in need.items():
            self._set(x, int(self.left[x]) - copies * n)
        self.patterns.append((lengths, copies))

    def slots(self) -> np.ndarray:
        """Rows (length, first rank, copies, first sequence, offset), by length and rank."""
        used, rows, sequence = Counter(), [], 0
        for lengths, copies in self.patterns:
            offset = 0
            for x in lengths:
                rows.append((x, used[x], copies, sequence, offset))
                used[x] += copies
                offset += x
            sequence += copies
        return np.asarray(sorted(rows), np.int64).reshape(-1, 5)


def _place(slots: np.ndarray):
    """Pieces to places.  ``slots`` has a few rows for each length, however many pieces there are."""
    first = {int(x): (a, b) for x, a, b in zip(*(lambda u: (u[0], u[1], np.append(u[1][1:], len(slots))))(np.unique(slots[:, 0], return_index=True)), strict=True)} if len(slots) else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                a, b = first[int(x)]
                here = length == x
                at[here] = a + np.searchsorted(slots[a:b, 1], rank[here], side="right") - 1
            s = slots[at]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(5)], pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 4])],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", size: int = 2048, tokenizer_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per piece, with its sequence and its offset there.

    Null text is empty: one end id.  Only documents of more than ``size`` ids are cut; a
    very long text is encoded whole, in memory in proportion to its length.  Repeated
    rows are packed each; rows with a null id too.  Empty tables give empty results;
    extra columns are not read.  Ties between pieces of one length fall to their order in
    the input's tasks, which the written piece table fixes.
    """
    import public_tokenizers

    p = materialise(cut_pieces(docs, text=text, doc=doc, size=size, tokenizer_file=tokenizer_file or public_tokenizers.path("byte_bpe_50k.json"),
                               pattern=pattern or public_tokenizers.PATTERN), "pieces")
    per_task = p.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(size + 1, np.int64)
    for length, n in p.groupBy("length").count().collect():  # at most ``size`` rows
        histogram[length] = n
    ranked = p.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(Plan(histogram, size).slots()), out)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"))
