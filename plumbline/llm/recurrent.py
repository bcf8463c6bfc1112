"""A gated recurrent language model over words (operator 12).

Words are counted in Spark over all training documents.  The model knows the most
frequent ones; any other is the model's unknown word times its share among the rest, so
every text has a probability.  The output is factored: a softmax over classes of words,
then one over the words of the class.  Training goes over all training documents once, in
rounds: in each, every task goes on from the same parameters by truncated backpropagation
over its part of the round's documents, and the parameters that come out are averaged by
the tokens they have seen.  Scoring carries the state from window to window, so a
document of any length is scored whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import discard, materialise, read
from .words import split_column

END, UNKNOWN = 0, 1
#: Distinct words that a task counts before it sends them on; bytes of texts that it splits at once (one text at least); tokens that a task runs through the model at once; vectors that a task adds up; fewest lanes; tokens of a window in scoring.
COUNTED, SPLIT, CHUNK, FAN_IN, NARROW, AT_ONCE = 400_000, 1 << 20, 1 << 22, 64, 32, 1 << 14
LN10 = math.log(10)


@dataclass(frozen=True)
class Settings:
    """``words`` of the model (the end of a text and the unknown word among them), classes, sizes, and how it learns."""

    words: int = 4096
    classes: int = 64
    hidden: int = 16
    embedded: int = 16
    window: int = 16
    lanes: int = 512
    rounds: int = 4
    #: In learning, lanes and the longest run of tokens that starts from an empty state; scoring never cuts a document.
    learning_lanes: int = 256
    run: int = 1024
    rate: float = 0.1
    #: Words that tasks look up by themselves; the others meet their counts in a join.
    local_words: int = 65_536


@dataclass(frozen=True)
class Vocabulary:
    """Words by code, the most frequent first: their ids in the model, log10(count + 1), and whether they are in training texts."""

    words: list[bytes]
    ids: np.ndarray
    logs: np.ndarray
    known: np.ndarray
    first: np.ndarray  # the first id of each class, and the number of ids
    weights: np.ndarray  # training tokens of each id
    tokens: int
    distinct: int
    end: int
    rest_tokens: int
    rest_distinct: int

    @property
    def stored(self) -> str:
        """The type in which ids are stored."""
        return "<u2" if len(self.weights) <= 1 << 16 else "<i4"


def classes_of(weights: np.ndarray, classes: int) -> np.ndarray:
    """First ids of classes that hold about equal shares of the roots of the weights; ids go by falling weight."""
    share = np.cumsum(np.sqrt(weights + 1.0))
    bins = np.minimum((share / share[-1] * classes * (1 - 1e-9)).astype(int), classes - 1)
    return np.append(np.flatnonzero(np.diff(bins, prepend=-1)), len(weights))


class Gru:
    """The network, its gradient, and its parameters as one vector."""

    def __init__(self, vocab_size: int, first: np.ndarray, s: Settings, dtype=np.float32):
        self.s, self.first, self.dtype, self.n = s, np.asarray(first), dtype, vocab_size
        h, d, c = s.hidden, s.embedded, len(first) - 1
        self.widths = np.diff(self.first)
        self.class_of = np.repeat(np.arange(c), self.widths).astype(np.min_scalar_type(c))  # small integers are sorted by counting
        #: ``x``, ``c`` and ``o`` are the weights of inputs, of classes and of words, the biases last.
        self.shapes = {"e": (vocab_size, d), "x": (d + 1, 3 * h), "wh": (h, 3 * h), "c": (h + 1, c), "o": (vocab_size, h + 1)}
        self.size = sum(math.prod(x) for x in self.shapes.values())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, shape in self.shapes.items():
            out[k] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out | {"wx": out["x"][:-1], "b": out["x"][-1], "wc": out["c"][:-1], "bc": out["c"][-1], "wo": out["o"][:, :-1], "bo": out["o"][:, -1]}

    def first_parameters(self, weights: np.ndarray, seed: int = 12) -> np.ndarray:
        """Small random weights, and biases that make the network give the words' shares."""
        r, flat = np.random.default_rng(seed), np.zeros(self.size, np.float64)
        p = self.views(flat)
        for k in ("e", "wx", "wh", "wc", "wo"):
            p[k][:] = r.normal(size=p[k].shape) * (0.3 if k in ("e", "wx", "wh") else 0.02)
        w = np.asarray(weights, np.float64) + 1
        of_class = np.add.reduceat(w, self.first[:-1])
        p["bc"][:], p["bo"][:] = np.log(of_class / of_class.sum()), np.log(w / of_class[self.class_of])
        return flat.astype(self.dtype)

    def inputs(self, p: dict, seen: np.ndarray) -> np.ndarray:
        """The ids' embeddings and a 1 for the bias, step by lane by component."""
        x = np.ones((*seen.shape, self.s.embedded + 1), self.dtype)
        x[..., :-1] = np.take(p["e"], seen, axis=0)
        return x

    def states(self, p: dict, x: np.ndarray, keep: np.ndarray, h: np.ndarray, save: bool = False):
        """States after each step of a window, step by component by lane; ``keep`` is 0 where a document begins, ``h`` the state before, component by lane."""
        n, half = self.s.hidden, self.dtype(0.5)
        scale = np.repeat(np.asarray([half, half, 1], self.dtype), n)  # a logistic curve is a tanh of half the argument
        wh, resets = np.ascontiguousarray((p["wh"] * scale).T), ~keep.all(1)
        gates = np.matmul((p["x"] * scale).T, x.transpose(0, 2, 1))
        out = np.empty((len(gates), n, gates.shape[2]), self.dtype)
        # kept for the gradient: the states before each step, both gates and the new state, and what they got from the state before
        before, gh = (np.empty_like(out), np.empty_like(gates)) if save else (None, np.empty_like(gates[:1]))
        for t in range(len(gates)):
            if resets[t]:
                h = h * keep[t]
            now, zr, new = gh[t if save else 0], gates[t, : 2 * n], gates[t, 2 * n :]
            np.matmul(wh, h, out=now)
            zr += now[: 2 * n]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= half
            new += zr[n:] * now[2 * n :]
            np.tanh(new, out=new)
            if save:
                before[t] = h
            h = np.subtract(h, new, out=out[t])
            h *= zr[:n]
            h += new
        return out, (before, gates, gh)

    def outputs(self, p: dict, h: np.ndarray, want: np.ndarray, grad: dict | None = None):
        """Natural log probability of each wanted id after its state; with ``grad``, also the gradient at the states of the negative sum."""
        order = np.argsort(self.class_of[want], kind="stable")  # rows of a class are a slice from here on
        mine, ids = np.ones((len(h), self.s.hidden + 1), self.dtype), want[order]
        mine[:, :-1] = h[order]
        cls = self.class_of[ids].astype(np.int64)
        # states lie within 1, so exponents cannot overflow unless weights are this large
        large = max((np.ones(len(p["c"]), self.dtype) @ np.abs(p["c"])).max(), (np.abs(p["o"]) @ np.ones(p["o"].shape[1], self.dtype)).max()) > 60

        logits = mine @ p["c"]
        if large:
            logits -= logits.max(1, keepdims=True)
        at = np.arange(len(ids)) * logits.shape[1] + cls
        wanted = logits.reshape(-1)[at]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], self.dtype)
        value = (wanted - np.log(total)).astype(np.float64)
        if grad is not None:
            # the rows are divided by their totals in the narrower factors of the products
            logits.reshape(-1)[at] -= total
            share = (1 / total)[:, None]
            np.matmul((mine * share).T, logits, out=grad["c"])
            dh = logits @ p["wc"].T
            dh *= share

        # words within their class: the logits of all rows lie in one vector, row after row; a class of one word needs none
        widths, cuts = np.where(self.widths > 1, self.widths, 0), np.searchsorted(cls, np.arange(len(self.first)))
        rows = np.flatnonzero(widths[cls])
        if len(rows):
            wide = widths[cls[rows]]
            begins = np.cumsum(wide) - wide
            ends = np.concatenate([[0], np.cumsum(np.diff(cuts) * widths)]).tolist()
            lines = np.empty(ends[-1], self.dtype)
            parts = [(slice(cuts[c], cuts[c + 1]), slice(self.first[c], self.first[c + 1]), lines[ends[c] : ends[c + 1]].reshape(-1, widths[c])) for c in np.flatnonzero(np.diff(cuts) * widths)]
            for s, w, part in parts:
                np.matmul(mine[s], p["o"][w].T, out=part)
            if large:
                lines -= np.repeat(np.maximum.reduceat(lines, begins), wide)
            at = begins + ids[rows] - self.first[cls[rows]]
            wanted = lines[at]
            np.exp(lines, out=lines)
            total = np.add.reduceat(lines, begins)
            value[rows] += wanted - np.log(total)
            if grad is not None:
                lines[at] -= total
                share = np.zeros((len(ids), 1), self.dtype)
                share[rows, 0] = 1 / total
                mine *= share
                more = np.zeros_like(dh)
                for s, w, part in parts:
                    np.matmul(part.T, mine[s], out=grad["o"][w])
                    np.matmul(part, p["wo"][w], out=more[s])
                more *= share
                dh += more
        out = np.empty_like(value)
        out[order] = value
        if grad is None:
            return out
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    def learn(self, p: dict, read_ids: np.ndarray, want: np.ndarray, live: np.ndarray, keep: np.ndarray, h: np.ndarray):
        """(gradient of the negative log probability of a window, its log probability, the state after it)."""
        flat = np.zeros(self.size, self.dtype)
        g, n, x = self.views(flat), self.s.hidden, self.inputs(p, read_ids)
        hs, (before, gates, gh) = self.states(p, x, keep, h.T, save=True)
        at = np.flatnonzero(live)
        rows = np.ascontiguousarray(hs.transpose(0, 2, 1)).reshape(-1, n)
        value, d_out = self.outputs(p, rows[at], want.reshape(-1)[at], g)
        rows[:] = 0
        rows[at] = d_out
        dh = np.ascontiguousarray(rows.reshape(*want.shape, n).transpose(0, 2, 1))
        z, r, new = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        rec = np.empty((len(want), 3, *hs.shape[1:]), self.dtype)  # first what a step's gradient is multiplied by, then the products
        np.multiply((before - new) * z, 1 - z, out=rec[:, 0])
        at_new = (1 - z) * (1 - new * new)
        np.multiply(at_new, r, out=rec[:, 2])
        np.multiply(rec[:, 2] * gh[:, 2 * n :], 1 - r, out=rec[:, 1])
        resets = ~keep.all(1)
        for t in reversed(range(len(want))):
            if t + 1 < len(want):
                dh[t] += carried
            rec[t] *= dh[t]
            carried = p["wh"] @ rec[t].reshape(3 * n, -1)
            carried += dh[t] * z[t]
            if resets[t]:
                carried *= keep[t]
        g["wh"][:] = np.matmul(before, rec.reshape(gates.shape).transpose(0, 2, 1)).sum(0)
        np.multiply(dh, at_new, out=rec[:, 2])
        back = rec.reshape(gates.shape).transpose(0, 2, 1)
        g["x"][:] = np.matmul(x.transpose(0, 2, 1), back).sum(0)
        ids, dx = read_ids.reshape(-1).astype(np.min_scalar_type(self.n)), np.matmul(back, p["wx"].T).reshape(len(rows), -1)
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        g["e"][ids[order][starts]] = np.add.reduceat(dx[order], starts, axis=0)
        return flat, value.sum(), hs[-1].T


def lanes_of(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each token among all, step by lane, -1 for none; lengths of lanes, falling): documents one after the other in lanes of about equal length."""
    order = np.argsort(-lengths, kind="stable")
    heap = [(0, k) for k in range(min(lanes, len(lengths), max(NARROW, int(lengths.sum() // lengths.max()))))]
    put: list[list[int]] = [[] for _ in heap]
    for doc in order.tolist():
        load, k = heapq.heappop(heap)
        put[k].append(doc)
        heapq.heappush(heap, (load + int(lengths[doc]), k))
    loads = np.asarray([sum(int(lengths[d]) for d in x) for x in put])
    begin, by_load = np.cumsum(lengths) - lengths, np.argsort(-loads, kind="stable")
    at = np.full((len(put), int(loads.max())), -1, np.int64)
    for row, k in enumerate(by_load.tolist()):
        if put[k]:
            at[row, : loads[k]] = np.concatenate([np.arange(begin[d], begin[d] + lengths[d]) for d in put[k]])
    return np.ascontiguousarray(at.T), loads[by_load]


def windows_of(ids: np.ndarray, lengths: np.ndarray, lanes: int, window: int | None = None):
    """(places, ids read, ids wanted, live, keep, lanes) of each window of a group of runs of tokens.  Documents end with ``END``, so a document's first read is ``END``."""
    at, loads = lanes_of(lengths, lanes)
    starts = np.zeros(len(ids), bool)
    starts[np.cumsum(lengths) - lengths] = True
    before, t = np.concatenate([np.full(1, END, ids.dtype), ids[:-1]]), 0
    while t < len(at):
        n = int((loads > t).sum())
        steps = window or max(1, min(AT_ONCE // n, 256))
        here = at[t : t + steps, :n]
        t += steps
        live = here >= 0
        yield here, np.where(live, before[here], END), np.where(live, ids[here], END), live, ~(starts[here] & live), here.shape[1]


def score_group(net: Gru, p: dict, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each document of a group."""
    value, h = np.zeros(len(ids)), np.zeros((net.s.hidden, net.s.lanes), net.dtype)
    for here, seen, want, live, keep, n in windows_of(ids, lengths, net.s.lanes):
        hs, _ = net.states(p, net.inputs(p, seen), keep.astype(net.dtype), h[:, :n])
        at = np.flatnonzero(live)
        # the state after reading the word before predicts the word
        value[here.reshape(-1)[at]] = net.outputs(p, hs.transpose(0, 2, 1).reshape(-1, net.s.hidden)[at], want.reshape(-1)[at])
        h = hs[-1]
    return np.add.reduceat(value, np.cumsum(lengths) - lengths)


def cut(lengths: np.ndarray, most: int) -> np.ndarray:
    """Lengths of runs of at most ``most`` tokens, in order."""
    parts = -(-lengths // most)
    out = np.full(int(parts.sum()), most, np.int64)
    out[np.cumsum(parts) - 1] = lengths - (parts - 1) * most
    return out


class Learner:
    """Adaptive gradient steps, one a window.  ``flat`` is the parameters, then the squares seen."""

    def __init__(self, net: Gru, flat: np.ndarray):
        self.net, self.flat, self.tokens = net, flat.copy(), 0

    def group(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        net, h = self.net, np.zeros((self.net.s.learning_lanes, self.net.s.hidden), self.net.dtype)
        lengths = cut(lengths, net.s.run)
        params, squares = self.flat[: net.size], self.flat[net.size :]
        p = net.views(params)
        for _, seen, want, live, keep, n in windows_of(ids, lengths, net.s.learning_lanes, net.s.window):
            g, _, h = net.learn(p, seen, want, live, keep.astype(net.dtype), h[:n])
            g /= net.dtype(max(1, live.sum()))
            squares += g * g
            params -= net.dtype(net.s.rate) * g / np.sqrt(squares)
        self.tokens += len(ids)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """(rows, their words, words of each row), a bounded size of texts at a time."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, SPLIT + (size[begin - 1] if begin else 0), "right")))
            part = batch.slice(begin, end - begin)
            yield part, *split_column(part.column(column), lower=True)
            begin = end
    pa.default_memory_pool().release_unused()  # workers live on after the task


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, training tokens, all tokens) of a task's texts, in parts of a bounded size; the empty word is the end of a text."""
    kept, size = [], 0

    def added() -> pa.Table:
        sums = pa.TableGroupBy(pa.concat_tables(kept), "word", use_threads=False).aggregate([("n", "sum"), ("n_all", "sum")])
        return sums.select(["word", "n_sum", "n_all_sum"]).rename_columns(["word", "n", "n_all"])

    for rows, words, lengths in _texts(batches, 0):
        learned = ~rows.column(1).to_numpy(zero_copy_only=False)
        found = words.dictionary_encode()
        at, n = found.indices.to_numpy(), len(found.dictionary)
        counts = [np.append(np.bincount(k, minlength=n), ends) for k, ends in ((at[np.repeat(learned, lengths)], learned.sum()), (at, len(learned)))]
        kept.append(pa.table([pa.concat_arrays([found.dictionary, pa.array([b""], pa.binary())]), *counts], names=["word", "n", "n_all"]))
        size += n + 1
        if size > 2 * COUNTED:
            kept = [added()]
            size = len(kept[0])
            if size > COUNTED:
                yield from kept[0].combine_chunks().to_batches()
                kept, size = [], 0
    if kept:
        yield from added().combine_chunks().to_batches()


def held_out(doc: str):
    """Whether a document's id puts it among those that nothing is learned from; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(docs: DataFrame, *, text: str, doc: str) -> DataFrame:
    """(word, n, n_all): training tokens and all tokens of each word."""
    parts = docs.select(F.col(text).alias("text"), held_out(doc).alias("held")).mapInArrow(_count, "word binary, n long, n_all long")
    return materialise(parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")), "lm-words")


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """The most frequent words by all texts, of which the model takes those most frequent in training texts; a bounded number."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    top = counts.where(F.col("word") != F.lit(b"")).orderBy(F.desc("n_all"), "word").limit(s.local_words).collect()
    end = int((counts.where(F.col("word") == F.lit(b"")).agg(F.sum("n")).first()[0]) or 0)
    words, n = [bytes(r["word"]) for r in top], np.asarray([r["n"] for r in top], np.int64)
    chosen = np.lexsort((np.arange(len(n)), -n))[: max(0, s.words - 2)]
    chosen = chosen[n[chosen] > 0]
    rest = tokens - end - int(n[chosen].sum())
    weights = np.concatenate([[end, rest], n[chosen]]).astype(np.int64)
    # ids go by falling weight, so that classes are runs of ids; END and UNKNOWN keep theirs by being put first
    first = 2 + classes_of(weights[2:], max(1, s.classes - 2)) if len(chosen) else np.asarray([2])
    ids = np.full(len(words) + 1, UNKNOWN, np.int32)
    ids[chosen] = 2 + np.arange(len(chosen))
    logs = np.append(np.log10(n + 1.0), 0.0)
    return Vocabulary(words, ids, logs, np.append(n > 0, False), np.concatenate([[0, 1], first]).astype(np.int64), weights, int(tokens), int(distinct), end, rest, int(distinct) - (end > 0) - len(chosen))


_TOKENS = "key long, doc_id long, held_out boolean, slice int, n_tokens long, n_known long, known_log double, rest long, rest_log double, ids binary, rare array<struct<word:binary,n:long>>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes; ``ends`` are the rows' ends among the values."""
    at = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)])


def _tokens(v: Vocabulary):
    """Texts as ids of the model, with sums over the words that the task knows; the others are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, end_log = pa.array(v.words, pa.binary()), math.log10(v.end + 1.0)
        for rows, words, lengths in _texts(batches, 4):
            docs = np.repeat(np.arange(len(lengths)), lengths)
            codes = pc.fill_null(pc.index_in(words, value_set=mine), -1).to_numpy()
            of_words, logs = v.ids[codes], v.logs[codes]
            ids = np.full(len(words) + len(lengths), END, v.stored)
            ids[np.arange(len(words)) + docs] = of_words
            outside = of_words == UNKNOWN

            def sums(values: np.ndarray, docs=docs, n=len(lengths)) -> np.ndarray:
                return np.bincount(docs, values, n).astype(np.float64)  # without any word they would be integers

            other = np.flatnonzero(codes < 0)
            found = words.take(pa.array(other)).dictionary_encode()
            each, times = np.unique(docs[other] * max(1, len(found.dictionary)) + found.indices.to_numpy(), return_counts=True)
            of_doc, word = np.divmod(each, max(1, len(found.dictionary)))
            pairs = pa.StructArray.from_arrays([found.dictionary.take(pa.array(word)), pa.array(times, pa.int64())], ["word", "n"])
            others = pa.ListArray.from_arrays(pa.array(np.searchsorted(of_doc, np.arange(len(lengths) + 1)), pa.int32()), pairs)
            held = rows.column(2).to_numpy(zero_copy_only=False)
            part = np.where(held, -1, rows.column(3).to_numpy()).astype(np.int32)
            n_known = sums(v.known[codes]).astype(np.int64) + (v.end > 0)
            sizes = lengths + 1
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], *map(pa.array, (part, sizes, n_known, sums(logs) + end_log, sums(outside).astype(np.int64), sums(logs * outside))), _lists(ids, np.cumsum(sizes)), others], names=[x.split()[0] for x in _TOKENS.split(", ", 10)])

    return run


def tokenised(docs: DataFrame, v: Vocabulary, s: Settings, *, text: str, doc: str) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc).cast("long").alias("doc_id"), held_out(doc).alias("held"), F.col(text).alias("text"))
    part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(s.rounds)).cast("int")
    return materialise(rows.select("key", "doc_id", "held", part.alias("slice"), "text").mapInArrow(_tokens(v), _TOKENS), "lm-tokens", by="slice")


def _groups(batches: Iterator[pa.RecordBatch], column: int, stored: str) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows in groups of about ``CHUNK`` tokens, their ids and the documents' lengths."""
    rows, texts, held = [], [], 0

    def group():
        lengths = np.asarray([len(x) for x in texts], np.int64)
        return list(rows), np.concatenate(texts), lengths

    for batch in batches:
        part = [np.frombuffer(x.as_buffer(), stored) for x in batch.column(column)]
        begin = 0
        for k, x in enumerate(part):
            texts.append(x)
            held += len(x)
            if held >= CHUNK:
                rows.append(batch.slice(begin, k + 1 - begin))
                yield group()
                rows.clear()
                texts.clear()
                begin, held = k + 1, 0
        if begin < len(part):
            rows.append(batch.slice(begin))
    if texts:
        yield group()


def _learn(net_of, flat: np.ndarray, stored: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(net_of(), flat)
        for _, ids, lengths in _groups(batches, 0, stored):
            learner.group(ids, lengths)
        if learner.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([learner.tokens]), pa.array([(learner.flat.astype(np.float64) * learner.tokens).tobytes()], pa.binary())], names=["tokens", "total"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all rows' vectors; one vector is held, whatever the rows."""
    tokens, total = 0, None
    for batch in batches:
        for n, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(x.as_buffer(), np.float64)
            tokens, total = tokens + n, x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([total.tobytes()], pa.binary())], names=["tokens", "total"])


def train(tokens: DataFrame, v: Vocabulary, s: Settings) -> np.ndarray:
    """Parameters after all rounds.  Between rounds the driver adds up at most ``FAN_IN`` vectors, one at a time."""
    net = Gru(len(v.weights), v.first, s)
    flat = np.concatenate([net.first_parameters(v.weights), np.full(net.size, 1e-6, np.float32)]).astype(np.float32)
    size, first, stored = len(v.weights), v.first, v.stored
    for k in range(s.rounds):
        out = materialise(tokens.where(F.col("slice") == k).select("ids").mapInArrow(_learn(lambda: Gru(size, first, s), flat, stored), "tokens long, total binary"), "lm-round")
        n, parts = out.count(), out
        while n > FAN_IN:  # levels of sums
            n = -(-n // FAN_IN)
            parts = parts.repartition(n).mapInArrow(_add, "tokens long, total binary")
        seen, total = 0, np.zeros(len(flat))
        for r in parts.toLocalIterator():
            seen, total = seen + r["tokens"], total + np.frombuffer(r["total"], np.float64)
        if seen:
            flat = (total / seen).astype(np.float32)
        discard(out)
    return flat[: net.size]


_SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, rest long, rest_log double, model_log double"


def _score(net_of, params: np.ndarray, stored: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = net_of()
        p = net.views(params)
        for rows, ids, lengths in _groups(batches, 8, stored):
            value = score_group(net, p, ids, lengths) / LN10
            at = 0
            for batch in rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(value[at : at + batch.num_rows])], names=[x.split()[0] for x in _SCORED.split(", ")])
                at += batch.num_rows

    return run


def log_likelihood(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learned from the rows whose crc32 of the id, as text, leaves another remainder than 2
    by 7; a null id counts as such a row.  A null text is empty: it has its end only.
    Texts of any length are scored whole.  Repeated rows count, and are scored, each.
    Words equal in frequency go by their bytes.  Without training rows nothing is known,
    ``base_score`` is 0 and the model gives its first guess.  Empty tables give empty
    results; extra columns are not read.
    """
    counts = count_words(docs, text=text, doc=doc)
    v = vocabulary(counts, settings)
    tokens = tokenised(docs, v, settings, text=text, doc=doc)
    params = train(tokens, v, settings)
    size, first = len(v.weights), v.first
    scored = materialise(tokens.select(*[x.split()[0] for x in _SCORED.split(", ")[:8]], "ids").mapInArrow(_score(lambda: Gru(size, first, settings), params, v.stored), _SCORED), "lm-scores")
    # words that no task looks up are rare in the whole corpus, so none of them is a hot key
    rare = tokens.select("key", F.explode("rare").alias("x")).select("key", "x.word", F.col("x.n").alias("times")).join(counts.where("n > 0").select("word", "n"), "word")
    log = F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("rare_log")
    more = rare.groupBy("key").agg(F.sum("times").alias("rare_known"), log)
    base_mass, rest_mass = math.log10(v.tokens + v.distinct + 1), math.log10(v.rest_tokens + v.rest_distinct + 1)
    extra = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(more, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + extra - F.col("n_tokens") * base_mass).alias("base_score"), (F.col("model_log") + F.col("rest_log") + extra - F.col("rest") * rest_mass).alias("score"))


def op12_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of those that are not held out."""
    return log_likelihood(read(spark, sf_dir, "documents"))
