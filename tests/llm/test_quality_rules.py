import re
from collections import Counter, defaultdict

from plumbline.llm.quality_rules import clean, judge

from .odd import SCHEMA, empty, odd, odd_rows, rows_of

SPACE = "[\x20\x09-\x0d]+"


def words(t):
    return [x for x in re.split(SPACE, t or "") if x]


def base(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def normal(line):
    return re.sub(r"[\W\d_]+", " ", line.lower()).strip()


def brute(rows, max_docs, max_share):
    by_host = defaultdict(set)
    for _, t, host in rows:
        by_host[host].add(t or "")
    often = {}
    for host, texts in by_host.items():
        n = Counter(x for t in texts for x in {normal(line) for line in t.split("\n") if words(line)} if x)
        often[host] = {x for x, c in n.items() if c > max_docs and c > max_share * len(texts)}
    out = []
    for i, t, host in rows:
        n, *rest = base(t)
        failed = n < 10 or 100 * rest[-1] > 20 * n
        removed = sum(len(words(x)) for x in (t or "").split("\n") if normal(x) in often[host])
        kept = not failed and not (removed and (removed > 0.5 * n or n - removed < 10))
        text = t if not removed else "\n".join(x for x in t.split("\n") if normal(x) not in often[host] or not normal(x))
        out.append(((i, n, *rest, failed, kept), (i, text) if kept else None))
    return sorted((x for x, _ in out), key=str), sorted((y for _, y in out if y), key=str)


def check(df, rows, **limits):
    want, texts = brute(rows, **limits)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((tuple(r) for r in judge(df, **limits).select(*cols).collect()), key=str) == want
    assert sorted((tuple(r) for r in clean(df, **limits).select("doc_id", "text").collect()), key=str) == texts
    return want


def test_table(spark):
    rows = [(i, t, s) for i, t, _, s in rows_of(spark, "/root/testdata/sf0.01")]
    rows += [(10_000 + k, f"own words number w{chr(97 + k)}\nAll rights of this page are kept by its owner, 20{k}\nand every copy needs leave", "src0") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = check(df, rows, max_docs=3, max_share=0.02)
    assert any(not x[7] and not x[6] for x in want)
    check(df, rows, max_docs=20, max_share=0.1)


def test_odd(spark):
    rows = [(i, t, s) for i, t, _, s, *_ in odd_rows()]
    check(odd(spark), rows, max_docs=1, max_share=0.1)
    assert clean(odd(spark)).columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert judge(empty(spark)).count() == 0 and clean(empty(spark)).count() == 0


def test_large_host(spark):
    """The number of texts decides by itself, whatever share of the host they are."""
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    foot = "all rights of this page"
    rows = [(k, f"a page of its own with words that no other page has {name(k)}" + (f"\n{foot}" if k < 21 else "") + ("\nseen on twenty" if k < 20 else ""), "large") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in clean(df).collect()}
    assert len(got) == 1000 and not any(foot in t for t in got.values())
    assert sum("seen on twenty" in t for t in got.values()) == 20
    check(df, rows, max_docs=20, max_share=0.0)
