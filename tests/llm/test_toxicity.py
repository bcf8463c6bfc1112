import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm.toxicity import _CODE, _SIZE, LEET, NEARLY, READINGS, Restorer, count_trigrams, decode, language_model, lattice, learn, op7_toxicity, readings, score

from .odd import documents, empty, odd, odd_rows


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None}
    got = op7_toxicity(spark, sf).collect()
    assert len(got) == documents(spark, sf).count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    # some labels are noise: toxic marks on texts without a toxic word
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert sum(a == 1 for a, b in held if b) >= 0.9 * sum(b for _, b in held) > 0


def test_viterbi_restores_disguises(spark):
    text = "the wicked wizard hates the stupid old castle and the idiot prince " * 20
    lm = language_model(count_trigrams(spark.createDataFrame([(text,), (None,)], "text string"), "text"))
    restore = Restorer(lm)
    for disguised, word in (("stup1d", "stupid"), ("s t u p i d", "stupid"), ("w1z4rd", "wizard"), ("h@tes", "hates")):
        assert word in restore(f"so {disguised} it is"), disguised
    assert "idiot" in restore("you idiooooot")


def test_odd(spark):
    labels = spark.createDataFrame([(1, 0), (6, 1), (8, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    for with_labels in (labels, labels.where("doc_id = 1"), labels.limit(0)):
        model = learn(odd(spark), with_labels)
        got = score(odd(spark), model).collect()
        assert len(got) == len(odd_rows()) and all(np.isfinite(r["score"]) and 0 <= r["score"] <= 1 for r in got)
        assert score(empty(spark), model).count() == 0
    assert score(empty(spark), learn(empty(spark), labels)).count() == 0
    assert learn(odd(spark).withColumn("text", F.lit(None).cast("string")), labels) is not None


def test_every_disguise_reaches_the_lattice(spark):
    lm = language_model(count_trigrams(documents(spark, "/root/testdata/sf0.01"), "text"))
    restore = Restorer(lm)
    for disguised, words in (
        ("1d107", ["idiot"]), ("idio7", ["idiot"]), ("idi07", ["idiot"]), ("1053r", ["loser"]), ("a$$", ["ass"]), ("f00l", ["fool"]), ("iddiioott", ["idiot"]), ("stuupid", ["stupid"]),
        ("$ c u m", ["scum"]), ("sc um", ["scum"]), ("you are a i d i o t", ["a", "idiot"]), ("s t u p i d i d i o t", ["stupid", "idiot"]), ("(stup1d,1d10t)!", ["stupid", "idiot"]),
    ):
        got = restore(disguised)
        assert all(w in got for w in words), (disguised, got)
    assert restore("it is of a") == ["it", "is", "of", "a"]
    assert len(restore("ab1" * 100_000)) > 0  # in proportion to its length


def every_reading(token, lm, strict):
    """All ways through the lattice, the likeliest first, each scored letter by letter."""
    out = []
    for way in itertools.product(*lattice(token, strict=strict)):
        text, s, x, y = "".join(c for c, _ in way), sum(p for _, p in way), 0, 0
        for c in [*text, " "]:
            k = _CODE.get(c, 0)
            if k or y:
                s += lm[(x * _SIZE + y) * _SIZE + k]
                x, y = y, k
        out.append((s, text))
    return sorted(out, reverse=True)


def test_decode_equals_all_readings(spark):
    """Viterbi, by knots and with several readings, against an enumeration of whole lattices."""
    lm = language_model(count_trigrams(documents(spark, "/root/testdata/sf0.01"), "text")).ravel().tolist()
    draw = random.Random(5)
    tokens = ["stuupid", "1d107", "sc*m", "a$$", "i d i o t", "(b4dd)", "..", "", "é!é", "loooser", "xxyyy", "aab", "baa", "aabaa", "aabcaa", "aabcdaa"]
    tokens += ["".join(draw.choice("aeiostnrl") if draw.random() < 0.75 else draw.choice([*LEET, *"ttoo. -é"]) for _ in range(draw.randint(1, 11))) for _ in range(300)]
    tokens += ["".join(draw.choice("eost") for _ in range(draw.randint(4, 14))) for _ in range(200)]
    for token, strict in itertools.product(tokens, (False, True)):
        choices = lattice(token, strict=strict)
        if np.prod([float(len(x)) for x in choices]) > 20_000:
            continue
        every = every_reading(token, lm, strict)
        best = {" ".join(t.split()) for s, t in every if s > every[0][0] - 1e-9}
        assert " ".join(decode(token, lm, strict=strict)) in best, token
        assert abs(readings(token, lm, strict=strict)[0][0] - every[0][0]) < 1e-9
        some = readings(token, lm, strict=strict, most=READINGS)
        assert np.allclose([s for s, _ in some], [s for s, _ in every[: len(some)]]) and len(some) == min(READINGS, len(every)), token
        words = [w for s, t in some if s >= some[0][0] - NEARLY for w in t.split()]
        assert decode(token, lm, strict=strict, most=READINGS) == words
    assert len(tokens) > 500


def test_long_texts_cost_in_proportion(spark):
    """Two megabytes of blanks, of one letter, of one word, of knots side by side and apart."""
    restore = Restorer(language_model(np.ones(_SIZE**3, np.int64)))
    for piece in (" ", "\n", "a", "1", "ab", "aab", "xaa", "ab1", ".", "ab11cde"):
        assert restore(piece * (2_000_000 // len(piece))) is not None
    for piece in ("a ", "1 "):  # several readings of each state: in proportion too, but some 50 microseconds a character
        assert restore(piece * 20_000) is not None
