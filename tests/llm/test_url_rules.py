import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from plumbline.llm.url_rules import RULES, judge, op4_url_rules

from .odd import empty


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def region(host, path):
    fits = [(len(h + p), h + p) for _, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[1] if fits else None


def tokens(url):
    host, path = parts(url)
    last = path.rsplit("/", 1)[-1].rsplit(".", 1)
    query = url.split("?", 1)[1].split("#", 1)[0] if url and "?" in url else None
    kinds = [("h:", host.split(".")), ("p:", path.split("/")), ("e:", last[1:] if len(last) > 1 and re.fullmatch("[A-Za-z0-9]{1,5}", last[1]) else []), ("q:", [x.split("=")[0] for x in query.split("&")] if query is not None else [])]
    return frozenset(kind + re.sub("[0-9]+", "0", x) for kind, xs in kinds for x in xs if x)


def brute(rows, *, least, confidence, lift, held):
    """Verdicts of (url, block or None, fold): every combination of the tokens of every labelled URL, counted one by one."""
    bags = Counter((tokens(u), b, f) for u, b, f in rows if b is not None)
    n_all, b_all = sum(bags.values()), sum(n for (_, b, _), n in bags.items() if b)
    mixed = {f for _, b, f in bags if b} & {f for _, b, f in bags if not b}
    kept = []
    for c in {frozenset(c) for t, b, _ in bags if b for size in range(1, len(t) + 1) for c in combinations(sorted(t), size)}:
        n, b = Counter(), Counter()
        for (t, block, f), k in bags.items():
            if c <= t:
                n[f] += k
                b[f] += k * block
        sn, sb = sum(n.values()), sum(b.values())
        if sb < least or sb < confidence * sn or sb * n_all < lift * b_all * sn:
            continue
        tried = [f for f in n if f in mixed and sb - b[f] >= least and sb - b[f] >= confidence * (sn - n[f])]
        hn, hb = sum(n[f] for f in tried), sum(b[f] for f in tried)
        if hn >= held and hb >= confidence * hn:
            kept.append(c)
    return ["block" if any(c <= tokens(u) for c in kept) else "allow" for u, _, _ in rows]


def test_whole_table(spark):
    """Fixed rules, and mined verdicts against the enumeration, over all pages."""
    sf = "/root/testdata/sf0.01"
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op4_url_rules(spark, sf).collect()}
    assert sorted(got) == sorted(urls)
    fixed = {i: rule(*parts(u)) for i, u in urls.items()}
    labelled = sum(v is not None for v, _ in fixed.values())
    mined = dict(zip(urls, brute([(u, None if fixed[i][0] is None else fixed[i][0] == "block", region(*parts(u))) for i, u in urls.items()], least=max(5, -(-labelled * 5 // 1000)), confidence=0.8, lift=1.1, held=5), strict=True))
    for i, r in got.items():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (*parts(urls[i]), fixed[i][1], fixed[i][0] or mined[i])
        assert (r["precision"] is not None) == (fixed[i][0] is None and r["verdict"] == "block")
    free = [(r["host"], r["verdict"]) for r in got.values() if r["rule"] is None]
    assert ("example.net", "allow") in {(h.split(".", h.count(".") - 1)[-1], v) for h, v in free}


def labelled_pages():
    rows = [("spam", 1)] * 6 + [("spam/casino", 1)] * 6 + [("news", 0)] * 10 + [("news/casino", 0)] * 3 + [("blog/casino/win", 1)] * 12 + [("only/here", 1)] * 5
    urls = [(k, f"http://h{k % 3}.org/{p}?x{k}=1", bool(b), "one" if p == "only/here" else str(k % 2)) for k, (p, b) in enumerate(rows)]
    return urls + [(100 + k, f"http://other.org/{p}", None, None) for k, p in enumerate(("spam/new", "news/old", "win/casino", "blog", "only", ""))]


def verdicts(spark, urls, **how):
    df = spark.createDataFrame(urls, "page_id int, url string, bad boolean, part string")
    return {r["page_id"]: r["verdict"] for r in judge(df, rules=(), label=F.col("bad"), fold=F.col("part"), **how).select("_in.page_id", "verdict").collect()}


def test_mined_rules_against_enumeration(spark):
    """A token of one fold only makes no rule, however pure it is."""
    urls = labelled_pages()
    got = verdicts(spark, urls, min_support=0.1, min_confidence=0.9)
    want = dict(zip([u[0] for u in urls], brute([(u, b, f) for _, u, b, f in urls], least=5, confidence=0.9, lift=1.1, held=5), strict=True))
    assert got == want and got[100] == got[103] == "block" and got[101] == got[104] == got[105] == "allow"


def test_folds_of_blocks_alone_test_nothing(spark):
    """Blocks in two folds without an allowed row confirm each other and nothing else; one allowed row makes a fold a test, which may then fail."""
    blocks = [(k, f"http://h{k}.bad/{'es' if k % 2 else 'fr'}/x", True, "es" if k % 2 else "fr") for k in range(40)]
    allows = [(100 + k, f"http://h{k}.good/en/x", False, "good") for k in range(40)]
    free = [(200, "http://new.bad/en/x", None, None)]
    assert verdicts(spark, blocks + allows + free)[200] == "allow"
    tests = [(300 + k, f"http://g{k}.good/{p}/y", False, p) for k, p in enumerate(("es", "fr"))]
    assert verdicts(spark, blocks + allows + tests + free)[200] == "block"
    wrong = [(400 + k, f"http://g{k}.bad/{p}/x", False, p) for k in range(12) for p in ("es", "fr")]
    assert verdicts(spark, blocks + allows + wrong + free)[200] == "allow"


def test_urls_of_very_many_segments(spark):
    """They add no combinations of their own: fifty segments that always come together, and fifty on one page."""
    deep, alone = ("/".join(f"{x}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(50)) for x in ("d", "s"))
    urls = labelled_pages() + [(200 + k, f"http://deep.org/{deep}", True, str(k % 2)) for k in range(12)] + [(300, f"http://deep.org/{alone}", True, "0"), (301, f"http://other.org/{deep.split('/')[7]}", None, None)]
    got = verdicts(spark, urls, min_support=0.0, min_confidence=0.9)
    assert got[100] == got[301] == "block" and got[101] == "allow"


def test_odd(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "no scheme", None), (None, "http://a.com", "x"), (4, "HTTP://WWW.Example.COM/en/\nx?q#f", "x"), (4, "HTTP://WWW.Example.COM/en/\nx?q#f", "x"), (5, "x://É.net/es/" + "a" * 200_000, "x"), (6, "://", "h")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("key", F.lit("k")).withColumn("_rule", F.lit(1)).withColumn("host", F.lit("h"))
    got = sorted(((r["_in"]["page_id"], r["host"], r["path"], r["rule"]) for r in judge(df).collect()), key=str)
    want = sorted(((i, *parts(u), rule(*parts(u))[1]) for i, u, _ in rows), key=str)
    assert got == want
    assert judge(empty(spark).select(F.lit(1).alias("page_id"), F.col("text").alias("url"))).count() == 0
