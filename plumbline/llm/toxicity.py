"""Toxicity scores of deobfuscated text (operator 7).

Noisy channel: disguised spellings (leetspeak, spaced-out or repeated letters) become
lattices of characters, Viterbi decoding under a character language model of the whole
corpus restores the likeliest word, and the restored text is scored by a model learned
from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import materialise, read

#: The model's alphabet; anything else is a word's end (0).
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
_SIZE = len(LETTERS) + 1
_CODE = {c: k + 1 for k, c in enumerate(LETTERS)}

# Fixed table of disguises: what a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou",
}
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"((.)\2*)", re.S)
_LEET = re.compile(f"[{re.escape(''.join(LEET))}]")
_DOUBLED = re.compile(f"([{LETTERS}])\\1")
_SUSPECT = re.compile(rf"([{LETTERS}])\1|[{re.escape(''.join(LEET))}]|[.\-_ ]")
_SPELLED = re.compile(r"(?:[^\W_][.\-_]+){2,}[^\W_]")  # s.t.u.p.i.d
#: Where disguised runs of one character and symbols leave a choice that the best reading may miss.
_OPEN = re.compile(r"(.)\1\1|([^a-zß-ÿ])\2|[^\w\s.,;:'\"\-/]", re.S)
_PAIR = re.compile(r"\S\S")
#: Where a reading has a choice; between two knots stand two letters or more that have none.
_KNOT = re.compile(f"(?:([{LETTERS}])\\1+|[^{LETTERS}])(?:[{LETTERS}]?(?:([{LETTERS}])\\2+|[^{LETTERS}]))*")
_score = itemgetter(0)
#: Runs of single characters, and of pieces of at most two, in the lengths of tokens.
_SINGLES, _PIECES = re.compile(b"\x01{2,}"), re.compile(b"\x01*\x02[\x01\x02]+|\x01+\x02[\x01\x02]*")
#: Where the words of single characters end is less sure: so many readings, within so much log-likelihood of the best.
READINGS, NEARLY = 4, 4.0
PREFIXES = range(4, 8)


def letter_codes(text: str) -> np.ndarray:
    """Codes of the lower-cased text's characters in the alphabet."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


_TABLE = np.zeros(257, np.int64)
for _c, _k in _CODE.items():
    _TABLE[ord(_c)] = _k


def count_trigrams(docs: DataFrame, text: str) -> np.ndarray:
    """Character trigram counts over every whole text.  The result's size is the alphabet's cube."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                c = letter_codes(f"  {body or ''} ")
                keep = (c[2:] > 0) | (c[1:-1] > 0)  # not between words
                np.add.at(total, (c[:-2] * _SIZE * _SIZE + c[1:-1] * _SIZE + c[2:])[keep], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    out = np.zeros(_SIZE**3, np.int64)
    for code, n in docs.select(F.col(text)).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n")).collect():
        out[code] = n
    return out


def language_model(trigrams: np.ndarray) -> np.ndarray:
    """log P(c | two before), smoothed by bigrams and unigrams."""
    t = trigrams.reshape(_SIZE, _SIZE, _SIZE).astype(float)
    one = t.sum((0, 1)) + 1
    one /= one.sum()
    two = t.sum(0) + 5 * one
    two /= two.sum(1, keepdims=True)
    three = t + 5 * two
    return np.log(three / three.sum(2, keepdims=True))


_GAP = [("", 0.0), (" ", 0.0)]


def _options(c: str, n: int, strict: bool) -> list[tuple[str, float]]:
    """What a run of ``n`` times ``c`` may stand for and at what cost; a space is a word's end."""
    options = [(c, 0.0)] if c in _CODE else []
    options += [(x, -1.0) for x in LEET.get(c, "")]
    if n > 1 and strict:
        options = [(x + x, p) for x, p in options]
    elif n > 1:  # once or twice, whatever the length
        options += [(x + x, p - (0.0 if n == 2 else 0.5)) for x, p in options]
    if c in LEET and not c.isdigit():
        options += [] if strict else [(" ", -1.0)]
        options += [("", -1.0)] if c == "*" else []
    return options


#: The options of every run, strict or not; runs of three stand for all longer ones.
_RUNS = {strict: {c * n: _options(c, n, strict) for c in [*LETTERS, *LEET] for n in (1, 2, 3)} for strict in (False, True)}


def lattice(token: str, *, strict: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of one character, what it may stand for and at what cost.

    White space and punctuation end a word or stand for nothing, a symbol of ``LEET`` may
    also end one.  If ``strict``, every character of ``LEET`` is a letter and a longer run
    stands for two.
    """
    known = _RUNS[strict]
    out: list[list[tuple[str, float]]] = []
    for run, _ in _RUN.findall(token.lower()):
        options = known.get(run[:3], _GAP)
        if options is not _GAP or not out or out[-1] is not _GAP:
            out.append(options)
    return out


def readings(token: str, lm: list[float], *, strict: bool = False, most: int = 1) -> list[tuple[float, str]]:
    """(log-likelihood, text) of the ``most`` likeliest readings of disguised text, the likeliest first.

    Viterbi over the last two letters, 0 being a word's end, with the ``most`` best paths
    of each state.  ``lm`` is the flat language model.  Paths are chains, so a long text
    costs in proportion to its length.
    """
    best: dict[int, list[tuple[float, tuple | None]]] = {0: [(0.0, None)]}
    for options in lattice(token, strict=strict):
        letters, s = options[0]
        if len(options) == 1 == len(best) == len(letters):  # one state, one letter: nothing to compare
            ((xy, paths),) = best.items()
            k = _CODE[letters]
            s += lm[xy * _SIZE + k]
            best = {xy % _SIZE * _SIZE + k: [(score + s, (path, letters)) for score, path in paths]}
            continue
        nxt: dict[int, list[tuple[float, tuple | None]]] = {}
        for state, paths in best.items():
            top, way = paths[0]
            for letters, s in options:
                xy = state
                for c in letters:
                    k, y = _CODE.get(c, 0), xy % _SIZE
                    if k or y:  # a word ends once
                        s += lm[xy * _SIZE + k]
                        xy = y * _SIZE + k
                if most > 1:
                    nxt[xy] = sorted(nxt.get(xy, []) + [(score + s, (path, letters)) for score, path in paths], key=_score, reverse=True)[:most]
                elif xy not in nxt or nxt[xy][0][0] < top + s:
                    nxt[xy] = [(top + s, (way, letters))]
        best = nxt
    ends = sorted(((s + (lm[xy * _SIZE] if xy % _SIZE else 0.0), p) for xy, paths in best.items() for s, p in paths), key=_score, reverse=True)[:most]
    out = []
    for s, path in ends:
        letters = []
        while path:
            path, last = path
            letters.append(last)
        out.append((s, "".join(reversed(letters))))
    return out


def decode(token: str, lm: list[float], *, strict: bool = False, most: int = 1, known: dict[str, str] | None = None) -> list[str]:
    """The words of the likeliest reading of disguised text, then those of up to ``most`` - 1 readings nearly as likely.

    The likeliest reading alone is put together from those of the text's knots, each with
    two letters before and behind it: these are the whole state of the model, so knots do
    not bear on each other.  ``known`` remembers the readings of short knots.
    """
    if most > 1:
        found = readings(token, lm, strict=strict, most=most)
        return [w for s, text in found if s >= found[0][0] - NEARLY for w in text.split()]
    token, out, at = token.lower(), [], 0
    known = {} if known is None else known
    for m in _KNOT.finditer(token):
        begin, end = max(m.start() - 2, 0), min(m.end() + 2, len(token))
        knot = token[begin:end]
        text = known.get(knot)
        if text is None:
            text = readings(knot, lm, strict=strict)[0][1]
            if len(knot) <= 16:
                if len(known) >= 100_000:
                    known.clear()
                known[knot] = text
        out += (token[at : m.start()], text[m.start() - begin : len(text) - (end - m.end())])
        at = m.end()
    return "".join([*out, token[at:]]).split()


class Restorer(dict):
    """Words of a text: as they stand, and those restored from disguises.

    Every token with a character of ``LEET`` or a doubled letter, and every run of single
    characters or of pieces of at most two, goes through the lattice.  As a mapping, the words of each token (lower case,
    without white space), and of each run the words that its tokens lack, remembered for
    those seen before.
    """

    def __init__(self, lm: np.ndarray):
        self.lm = lm.ravel().tolist()
        self.knots: tuple[dict[str, str], dict[str, str]] = {}, {}

    def restored(self, text: str) -> list[str]:
        most = READINGS if text[1:2] == " " and not _PAIR.search(text) else 1
        words = decode(text, self.lm, most=most, known=self.knots[0])
        return words + decode(text, self.lm, strict=True, most=most, known=self.knots[1]) if _OPEN.search(text) else words

    def __missing__(self, token: str) -> list[str]:
        plain = _WORD.findall(token)
        new: list[str] = []
        if not _SUSPECT.search(token):
            pass
        elif " " in token or _LEET.search(token) or _SPELLED.search(token):
            new = self.restored(token)
        else:
            for w in plain:
                if _DOUBLED.search(w):
                    new += self.restored(w)
        new = [w for w in dict.fromkeys(new) if w not in plain]
        words = new if " " in token else plain + new
        if len(token) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[token] = words
        return words

    def __call__(self, text: str) -> list[str]:
        tokens = text.lower().split()
        words = list(chain.from_iterable(map(self.__getitem__, tokens)))
        lengths = bytes([n if n < 3 else 0 for n in map(len, tokens)])
        for m in chain(_SINGLES.finditer(lengths), _PIECES.finditer(lengths)):
            words += self[" ".join(tokens[m.start() : m.end()])]
        return words


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


def _restored(lm: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(lm)
        for batch in batches:
            words = [restore(b or "") for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1)], names=["words", "toxic"])

    return run


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for words, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update({f for w in set(words) for f in word_features(w)})
    keys = [*toxic, *(k for k in clean if k not in toxic)]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])


def learn_lexicon(train: DataFrame, *, n_toxic: int, n_clean: int, least_g2: float = 25.0) -> dict[str, float]:
    """From rows (words, toxic): log-odds of all features that are significantly commoner in toxic documents.

    A feature needs a handful of documents to be significant, so there are fewer than the
    labelled documents have words; their number has a bound.
    """
    f = train.select("words", "toxic").mapInArrow(_feature_counts, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n = float(n_toxic + n_clean)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    total = F.col("a") + F.col("b")
    g2 = 2 * (term(F.col("a"), total * (n_toxic / n)) + term(F.col("b"), total * (n_clean / n)))
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("b") + 0.5) / (n_clean + 1.0))
    top = f.select("feature", odds.alias("w"), g2.alias("g2")).where((F.col("w") > 1.5) & (F.col("g2") >= least_g2))
    return {r["feature"]: r["w"] for r in top.collect()}


class WordWeights(dict):
    """A word's largest log-odds over its features; remembered for words seen before."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        w = max((self.lexicon.get(f, 0.0) for f in word_features(word)), default=0.0)
        if len(self) < 400_000:
            self[word] = w
        return w


def evidence(words: list[str], weights: WordWeights) -> list[float]:
    """What the model sees of a document: strongest weight, distinct weights summed, hits, hits a hundred words."""
    hits = [(x, w) for x, w in zip(map(weights.__getitem__, words), words, strict=True) if x > 0]
    if not hits:
        return [0.0, 0.0, 0.0, 0.0]
    distinct = {w: x for x, w in hits}
    return [max(distinct.values()), math.log1p(sum(distinct.values())), math.log1p(len(hits)), 100.0 * len(hits) / len(words)]


@dataclass(frozen=True)
class Model:
    lm: np.ndarray
    lexicon: dict[str, float]
    coefficients: tuple[float, ...]
    intercept: float

    def scorer(self) -> Callable[[str | None], float]:
        restore, weights = Restorer(self.lm), WordWeights(self.lexicon)

        def score(text: str | None) -> float:
            z = self.intercept + sum(a * b for a, b in zip(self.coefficients, evidence(restore(text or ""), weights), strict=True))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc: str = "doc_id", label: str = "toxic", max_labelled: int = 8000) -> Model:
    """A model from labelled documents.

    The language model counts every document.  The classifier is fitted on at most
    ``max_labelled`` labelled rows, those of the smallest hashes of the id, so the
    labels are small enough to broadcast whatever the table's size.

    Null labels and ids teach nothing; an id that is labelled twice is two examples, and a
    document that repeats is one example each time.  Without documents of both labels
    every score is alike.  Empty tables give such a model; extra columns are not read.
    """
    lm = language_model(count_trigrams(docs, text))
    some = (labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("label_id"), (F.col(label) > 0).alias("toxic"))
            .orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(max_labelled))
    train = materialise(docs.join(F.broadcast(some), F.col(doc) == F.col("label_id")).select(F.col(text).alias("text"), "toxic"), "toxicity-train")
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(n) < 2:  # nothing to tell apart
        return Model(lm, {}, (0.0,) * 4, 0.0 if not n else (-7.0 if False in n else 7.0))
    train = train.repartition(max(4, min(64, sum(n.values()) // 100)))
    train = materialise(train.mapInArrow(_restored(lm), "words array<string>, toxic boolean"), "toxicity-words")
    lexicon = learn_lexicon(train, n_toxic=n[True], n_clean=n[False])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = WordWeights(lexicon)
        for batch in batches:
            x = [evidence(words, weights) for words in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    rows = materialise(train.select("words", F.col("toxic").cast("double")).mapInArrow(run, "x array<double>, label double"), "toxicity-evidence")
    fit = LogisticRegression(regParam=0.001, maxIter=50).fit(rows.select(array_to_vector("x").alias("features"), "label"))
    return Model(lm, lexicon, tuple(float(c) for c in fit.coefficients), float(fit.intercept))


def score(docs: DataFrame, model: Model, *, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, score), one row per input row.

    Null text is empty; a row's score depends on its whole text alone, however long, so
    repeated rows tie.  Empty tables give empty results; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(b) for b in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, score double")


def held_out(doc: str = "doc_id"):
    """Rows that no label is learned from.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of held-out documents are not used."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
