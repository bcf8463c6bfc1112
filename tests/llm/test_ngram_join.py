import random
import tracemalloc

import numpy as np
import pyarrow as pa

from plumbline.llm import ngram_join
from plumbline.llm.ngram_join import join, op5_ngram_join

from .odd import empty, odd, odd_rows, rows_of


def shingle_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, parent = [(i, shingle_set(t)) for i, t in rows], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        root(i)
        for j, t in sets[:k]:
            if j is None or not s or not t or 4 * min(len(s), len(t)) < 3 * max(len(s), len(t)):
                continue
            if 100 * len(s & t) >= 75 * len(s | t):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(i, t) for i, t, *_ in rows_of(spark, sf)])
    assert sum(i != c for i, _, c in want) > 50
    assert result(op5_ngram_join(spark, sf)) == want


def test_common_passages_and_large_groups(spark):
    """Columns of many documents, and documents that they dominate."""
    r = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows, word = [], lambda: f"w{r.randrange(5000)}"
    for k in range(300):  # a passage in all, own words in differing numbers
        own = [word() for _ in range(r.choice((4, 10, 14, 18, 22, 30, 200)))]
        rows.append((k, " ".join(passage + own)))
    near = [word() for _ in range(120)]
    for k in range(300, 520):  # near copies of one text
        x = list(near)
        for _ in range(r.randrange(4)):
            x[r.randrange(len(x))] = word()
        rows.append((k, " ".join(x)))
    rows += [(k, " ".join(word() for _ in range(r.randrange(1, 9)))) for k in range(520, 600)]
    rows += [(600, "a b c d"), (601, "A b  c\nd"), (602, "a b c d e"), (603, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(join(df, block_rows=3000)) == brute(rows)
    assert result(join(df, block_rows=50, sketch=10)) == brute(rows)


def test_leaders_and_blocks(spark, monkeypatch):
    """Near copies of one text, farther ones that only chains join, and cuts of it with words of their own; looked up in chunks of few and of many documents."""
    r = random.Random(7)
    word = lambda: f"w{r.randrange(5000)}"
    base = [word() for _ in range(100)]
    rows = []
    for k in range(160):
        x = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 9))):
            x[r.randrange(len(x))] = word()
        rows.append((k, " ".join(x)))
    rows += [(k, " ".join(base[: r.randrange(70, 100)] + [word() for _ in range(r.randrange(0, 30))])) for k in range(200, 260)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert 5 < len({c for _, _, c in want}) < 200
    for together in (3, 32, 1000):
        monkeypatch.setattr(ngram_join, "_TOGETHER", together)
        assert result(join(df, block_rows=3000)) == want


def test_odd(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    assert result(join(odd(spark))) == brute(rows)
    assert join(empty(spark)).count() == 0


def test_memory_of_a_block_goes_by_distinct_pairs(monkeypatch):
    """Many columns of the same documents: pairs are counted as they come, in parts of any size."""
    rows, columns = 60, 4000
    h = np.tile(np.arange(columns, dtype=np.uint64), rows)
    one = lambda x: [np.asarray(x, np.int64).tobytes()]
    n = [columns] * rows
    block = pa.RecordBatch.from_pydict({"block": [0], "ids": one(np.arange(rows)[::-1]), "n": one(n), "k": one(n), "lengths": one(n), "hashes": [h.tobytes()]})
    tracemalloc.start()
    got = pa.Table.from_batches(ngram_join._product(iter([block])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == rows * (rows - 1) // 2 and set(got["common"].to_pylist()) == {columns}
    assert all(a < b for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert peak < 100e6  # 7,080,000 pairs, 57 MB in one list of them; the product used to hold several
    monkeypatch.setattr(ngram_join, "_HELD", 1000)
    assert pa.Table.from_batches(ngram_join._product(iter([block]))).sort_by([("a", "ascending"), ("b", "ascending")]) == got.sort_by([("a", "ascending"), ("b", "ascending")])
