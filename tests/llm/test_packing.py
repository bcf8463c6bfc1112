import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm.packing import Plan, op10_best_fit_packing, pack

from .odd import empty, odd, odd_rows, rows_of


def check(got, rows, size):
    """An exact round trip: all pieces of all texts, in gapless sequences."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in rows:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        cuts = [0, *range(first, len(ids), size), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= size
    return len(held), -(-sum(x[3] for x in want) // size)


def test_round_trip(spark):
    sf = "/root/testdata/sf0.01"
    used, least = check(op10_best_fit_packing(spark, sf).collect(), [(i, t) for i, t, *_ in rows_of(spark, sf)], 2048)
    assert used <= least + max(1, least // 100)


def test_odd(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(70, "<|endoftext|> x"), (71, "Ǆ漢字 ‍   a\r\n\n b's 12３"), (72, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(pack(df, size=64).collect(), rows, 64)
    assert pack(odd(spark)).count() > len(odd_rows()) and pack(empty(spark)).count() == 0


def test_blanks_without_end(spark):
    """Two megabytes of spaces, of newlines, and of one word."""
    n = 2_000_000
    rows = [(1, " " * n), (2, "\n" * n), (3, "a" + "\t" * 20_000 + "b <|endoftext|>"), (4, "x" * n)]
    check(pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), rows, 2048)


def test_plan_against_exhaustive_packing():
    def fewest(lengths, size):
        best = [len(lengths)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(lengths):
                best[0] = len(bins)
                return
            for b in {x: j for j, x in enumerate(bins)}.values():
                if bins[b] + lengths[k] <= size:
                    bins[b] += lengths[k]
                    go(k + 1, bins)
                    bins[b] -= lengths[k]
            go(k + 1, [*bins, lengths[k]])

        go(0, [])
        return best[0]

    r = np.random.default_rng(1)
    extra = 0
    for _ in range(30):
        lengths = sorted(r.integers(1, 21, 9).tolist(), reverse=True)
        plan = Plan(np.bincount(lengths, minlength=21), 20)
        assert sorted(x for p, n in plan.patterns for x in p * n) == sorted(lengths) and all(sum(p) <= 20 for p, _ in plan.patterns)
        extra += sum(n for _, n in plan.patterns) - fewest(lengths, 20)
    assert extra <= 3
