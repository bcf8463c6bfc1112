import math
import time
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import recurrent
from plumbline.llm.recurrent import END, Gru, Learner, Settings, classes_of, cut, lanes_of, log_likelihood, op12_recurrent_lm, score_group
from plumbline.llm.words import split, split_column

from .odd import empty, odd, odd_rows, rows_of

TINY = Settings(words=40, classes=7, hidden=5, embedded=4, window=6, lanes=3, rounds=2, learning_lanes=4, run=16)


def base_rows(rows):
    """The counted columns, by the book."""
    tokens = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    c = Counter(w for _, held, x in tokens if not held for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, held, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)) for i, held, x in tokens]


def counted(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()), key=str)


def network(size=12, dtype=np.float64, settings=TINY):
    weights = np.arange(2 * size, size, -1)
    first = np.concatenate([[0, 1], 2 + classes_of(weights[2:], settings.classes - 2)])
    net = Gru(size, first, settings, dtype)
    return net, net.first_parameters(weights) * dtype(3)


def plain_score(net, p, ids):
    """One step after the other, the whole softmax written out."""
    n, h, out, seen = net.s.hidden, np.zeros(net.s.hidden), 0.0, END
    sig = lambda x: 1 / (1 + np.exp(-x))
    for want in ids:
        gx, gh = p["e"][seen] @ p["wx"] + p["b"], h @ p["wh"]
        z, r = sig(gx[:n] + gh[:n]), sig(gx[n : 2 * n] + gh[n : 2 * n])
        h = (1 - z) * np.tanh(gx[2 * n :] + r * gh[2 * n :]) + z * h
        each = np.zeros(net.n)
        of_class = np.exp(h @ p["wc"] + p["bc"])
        for c, share in enumerate(of_class / of_class.sum()):
            lo, hi = net.first[c], net.first[c + 1]
            e = np.exp(p["wo"][lo:hi] @ h + p["bo"][lo:hi])
            each[lo:hi] = share * e / e.sum()
        assert each.sum() == pytest.approx(1)
        out += math.log(each[want])
        seen = want
    return out


def texts(r, lengths, size):
    return np.concatenate([np.append(r.integers(1, size, n - 1), END) for n in lengths])


def test_lanes_score_as_one_step_after_the_other():
    r = np.random.default_rng(0)
    net, flat = network()
    p, lengths = net.views(flat), np.asarray([1, 9, 30, 2, 6, 12, 7])
    ids = texts(r, lengths, net.n)
    got = score_group(net, p, ids, lengths)
    ends = np.cumsum(lengths)
    assert np.allclose(got, [plain_score(net, p, ids[e - n : e].tolist()) for e, n in zip(ends, lengths, strict=True)])


def test_gradient():
    r = np.random.default_rng(1)
    net, flat = network()
    seen, want = r.integers(0, net.n, (6, 4)), r.integers(0, net.n, (6, 4))
    live, keep, h = r.random((6, 4)) < 0.8, (r.random((6, 4)) < 0.8).astype(float), r.normal(size=(4, net.s.hidden))
    g, value, _ = net.learn(net.views(flat), seen, want, live, keep, h)
    for k in r.choice(net.size, 150, replace=False):
        both = []
        for step in (1e-6, -1e-6):
            near = flat.copy()
            near[k] += step
            both.append(-net.learn(net.views(near), seen, want, live, keep, h)[1])
        assert g[k] == pytest.approx((both[0] - both[1]) / 2e-6, abs=2e-6)


def test_large_weights():
    """Exponents beyond what a float holds: rows of both softmaxes are lowered by their largest first."""
    r = np.random.default_rng(4)
    net, flat = network()
    p, lengths = net.views(flat * 4000), np.asarray([5, 20, 1, 8])
    assert flat.max() * 4000 > math.log(np.finfo(float).max) and np.isfinite(score_group(net, p, texts(r, lengths, net.n), lengths)).all()
    logits = lambda x, w, b: (x @ w + b) - (x @ w + b).max()
    h, want = np.full((1, net.s.hidden), 0.9), np.asarray([7])
    c = net.class_of[7]
    a, e = logits(h[0], p["wc"], p["bc"]), logits(h[0], p["wo"][net.first[c] : net.first[c + 1]].T, p["bo"][net.first[c] : net.first[c + 1]])
    assert net.outputs(p, h, want)[0] == pytest.approx(a[c] - np.log(np.exp(a).sum()) + e[7 - net.first[c]] - np.log(np.exp(e).sum()))


ODD = ["", " ", None, "a", " a ", "a  b\x1cc\u3000d", "\u0130STANBUL \u0391\u0392 ABC\x85abc\xa0x", "\t\n\x0b\x0c\r x\x00y\x1d \x1f", "  \x85", "x" * 5000, " " * 5000, "".join(map(chr, range(0x3000)))]


def test_columns_are_split_as_texts():
    for lower in (False, True):
        for part in (pa.array(ODD), pa.array(ODD).slice(3, 6), pa.array(ODD, pa.large_string()), pa.array([None], pa.string()), pa.array([], pa.string())):
            words, counts = split_column(part, lower=lower)
            plain = [split(x, lower=lower) for x in part.to_pylist()]
            assert words.to_pylist() == [w for x in plain for w in x] and counts.tolist() == [len(x) for x in plain]


def text_passes(rows, words=65_536):
    """What the tasks make of (id, held out, text): counts by word, and the rows of tokens."""
    docs, held, column = pa.array([i for i, *_ in rows]), pa.array([h for _, h, _ in rows]), pa.array([t for *_, t in rows], pa.string())
    counts = {}
    for batch in recurrent._count(iter([pa.RecordBatch.from_arrays([column, held], names=["text", "held"])])):
        for w, *n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[w] = [a + b for a, b in zip(counts.get(w, (0, 0)), n, strict=True)]
    top = sorted((w for w in counts if w), key=lambda w: (-counts[w][1], w))[:words]
    n = np.asarray([counts[w][0] for w in top], np.int64)
    ids = np.append(np.where((np.arange(len(n)) < 4000) & (n > 0), 2 + np.arange(len(n)), recurrent.UNKNOWN), recurrent.UNKNOWN).astype(np.int32)
    v = recurrent.Vocabulary(top, ids, np.append(np.log10(n + 1.0), 0), np.append(n > 0, False), np.asarray([0, 1]), np.ones(ids.max() + 1), 0, 0, counts[b""][0], 0, 0)
    batch = pa.RecordBatch.from_arrays([docs, docs, held, pa.array([0] * len(rows), pa.int32()), column], names=list("abcde"))
    return counts, v, lambda: [r for b in recurrent._tokens(v)(iter([batch])) for r in b.to_pylist()]


@pytest.mark.parametrize("split_at,counted", [(1 << 20, 400_000), (1, 3), (600, 40)])
def test_text_passes(monkeypatch, split_at, counted):
    """Texts in parts of any size, sums that are sent on or kept: as word by word."""
    monkeypatch.setattr(recurrent, "SPLIT", split_at)
    monkeypatch.setattr(recurrent, "COUNTED", counted)
    rows = [(k, k % 3 == 1, t) for k, t in enumerate([*ODD, *(f"w{k % 7} W{k} end w{k % 7}" for k in range(90)), *ODD])]
    counts, v, tokens = text_passes(rows, 20)
    tokens_of = {k: split(t, lower=True) for k, _, t in rows}
    each = [Counter(w for k, held, _ in rows if not held or all_ for w in [*tokens_of[k], b""]) for all_ in (False, True)]
    assert counts == {w: [each[0][w], n] for w, n in each[1].items()}
    code = {w: k for k, w in enumerate(v.words)}
    for (k, held, _), r in zip(rows, tokens(), strict=True):
        codes = [code.get(w, -1) for w in tokens_of[k]]
        rare = Counter(w for w, c in zip(tokens_of[k], codes, strict=True) if c < 0)
        assert (r["key"], r["doc_id"], r["held_out"], r["slice"], r["n_tokens"]) == (k, k, held, -1 if held else 0, len(codes) + 1)
        assert np.frombuffer(r["ids"], v.stored).tolist() == [*(int(v.ids[c]) for c in codes), END] and {x["word"]: x["n"] for x in r["rare"]} == rare
        assert r["n_known"] == 1 + sum(bool(v.known[c]) for c in codes) and r["rest"] == sum(v.ids[c] == recurrent.UNKNOWN for c in codes)
        assert r["known_log"] == pytest.approx(math.log10(v.end + 1) + sum(v.logs[c] for c in codes)) and r["rest_log"] == pytest.approx(sum(v.logs[c] for c in codes if v.ids[c] == recurrent.UNKNOWN))


def test_text_passes_are_cheap(spark):
    """Counting a task's words takes less time than a plain loop over them."""
    texts_of = [t for _, t, *_ in rows_of(spark, "/root/testdata/sf0.01")] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(texts_of, pa.string()), pa.array([False] * len(texts_of))], names=["text", "held"])

    def plain():
        c = Counter()
        for t in texts_of:
            c.update(split(t, lower=True))

    def seconds(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: list(recurrent._count(iter([batch])))) < seconds(plain)


def test_learns_an_order():
    """Words that alternate are foretold after learning; documents longer than a run are learned from whole."""
    s = replace(TINY, rate=0.1)
    net, flat = network(12, np.float32, s)
    ids = np.asarray(([2, 5, 3] * 40 + [END]) * 30, np.int32)
    lengths = np.full(30, 121)
    learner = Learner(net, np.concatenate([flat, np.full(net.size, 1e-6, np.float32)]))
    before = score_group(net, net.views(flat), ids, lengths).sum()
    for _ in range(6):
        learner.group(ids, lengths)
    assert score_group(net, net.views(learner.flat[: net.size]), ids, lengths).sum() > 0.1 * before and learner.tokens == 6 * len(ids)


def test_lanes_and_runs():
    r = np.random.default_rng(3)
    for _ in range(20):
        lengths = r.integers(1, 50, r.integers(1, 60))
        at, loads = lanes_of(lengths, int(r.integers(1, 80)))
        assert sorted(at[at >= 0].tolist()) == list(range(lengths.sum())) and (np.diff(loads) <= 0).all() and loads.sum() == lengths.sum()
        assert (cut(lengths, 7) > 0).all() and cut(lengths, 7).max() <= 7 and set(np.cumsum(lengths)) <= set(np.cumsum(cut(lengths, 7)))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = op12_recurrent_lm(spark, sf).persist()
    assert counted(got) == sorted(base_rows([(i, t) for i, t, *_ in rows_of(spark, sf)]), key=str)
    held = got.where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert held[1] > held[0] + 0.02 * held[2]  # texts that it has not seen, against the words' shares alone
    assert got.where("score IS NULL OR score >= 0").isEmpty()


def test_words_of_the_join(spark):
    """Most words are counted through the join; the base, and the model's score, are as if all were looked up."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").coalesce(1)
    few, all_ = (log_likelihood(docs, settings=replace(TINY, local_words=n)) for n in (60, 100_000))
    assert counted(few) == counted(all_)
    a, b = ({r["doc_id"]: r["score"] for r in x.collect()} for x in (few, all_))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-6) for k in a)


def test_odd(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(50, "x" * 300_000), (51, " " * 300_000), (52, "İSTANBUL ΑΒΓ ABC abc"), (53, "a b\x1cc　d")]
    extra = spark.createDataFrame(rows[-4:], "doc_id long, text string")
    got = log_likelihood(odd(spark).unionByName(extra, allowMissingColumns=True), settings=TINY)
    assert counted(got) == sorted(base_rows(rows), key=str)
    one = {}
    for r in got.collect():  # equal texts score alike
        text = [t for i, t in rows if i == r["doc_id"]]
        if len(text) == 1:
            assert one.setdefault(text[0], r["score"]) == pytest.approx(r["score"], rel=1e-6)
    assert log_likelihood(empty(spark), settings=TINY).count() == 0
    held = odd(spark).where("doc_id IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2")
    ids = [(i, t) for i, t, *_ in odd_rows() if i is not None and zlib.crc32(str(i).encode()) % 7 == 2]
    assert counted(log_likelihood(held, settings=TINY)) == sorted(base_rows(ids), key=str)
