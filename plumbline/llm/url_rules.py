"""URL filter by fixed rules and mined association rules (operator 4, native).

Labels are few and stand in some regions of the URLs only, so a combination of tokens
becomes a rule only if it holds where it was not learned: labelled rows are in folds (by
default one for each fixed rule, with the exceptions that longer rules make in it), and
what the other folds teach is tried on each that could refute it: a fold of blocks alone
confirms any rule, so it teaches but does not test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import materialise, read

# Fixed rules of the contract: verdict, host, path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "verdict=block"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://((?s:.*))$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null.  The rules are literals of the plan."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    made = [F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")) for v, h, p in ordered]
    return F.coalesce(*[F.when(f, m) for f, m in zip(fits, made, strict=True)]) if made else F.lit(None).cast("struct<verdict:string,rule:string>")


def region(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Host and path of the shortest rule that fits, else null: a rule and the exceptions in it are one region."""
    ordered = sorted(rules, key=lambda r: len(r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p)) for _, h, p in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The URL's distinct tokens: scheme, host labels, words of the path, file ending, names of query fields.

    Numbers become one token each kind, so that baskets repeat.
    """
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))
    last = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    fields = F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(
        named("h:", F.split(host, r"\.", -1)), named("p:", F.split(path, "/", -1)), named("e:", F.array(last)), named("q:", fields))))


def _judged(folds: Column, n: Column, b: Column, min_count: Column, min_confidence: float) -> Column:
    """struct(held, right): rows of the testing folds that the other folds' rows would have blocked, and those of them that are blocks.

    ``folds`` has (fold, n, b, tests): rows and blocks of a combination in each fold, of
    ``n`` and ``b`` in all, and whether the fold has rows of both verdicts.
    """
    tried = F.filter(folds, lambda f: f["tests"] & (b - f["b"] >= min_count) & (b - f["b"] >= min_confidence * (n - f["n"])))
    total = lambda x: F.aggregate(tried, F.lit(0).cast("long"), lambda s, f: s + f[x])
    return F.struct(total("n").alias("held"), total("b").alias("right"))


def _counted(each: DataFrame, by: str) -> DataFrame:
    """(by, n, b, folds) of rows (by, fold, tests, n, b); there are few folds."""
    per = each.groupBy(by, "fold", "tests").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    return per.groupBy(by).agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.collect_list(F.struct("fold", "n", "b", "tests")).alias("folds"))


def token_items(bags: DataFrame, *, min_count: Column) -> DataFrame:
    """(token, item) of the tokens that a rule may use.  Tokens of the same labelled URLs are one item.

    ``bags`` are distinct (key, basket, fold, tests, n, b).  A token needs ``min_count`` blocks,
    and as many outside one of its folds, else no rule with it can hold.
    """
    each = bags.select("key", "fold", "tests", "n", "b", F.explode("basket").alias("token"))
    use = _counted(each, "token").where((F.col("b") >= min_count) & F.exists("folds", lambda f: F.col("b") - f["b"] >= min_count)).select("token")
    where = each.select("key", "token").distinct().groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("key")).alias("s"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("t"))
    same = where.join(use, "token", "left_semi")
    return same.join(same.groupBy("m", "s", "t").agg(F.min("token").alias("item")), ["m", "s", "t"]).select("token", "item")


def mine(rows: DataFrame, *, min_support: float) -> DataFrame:
    """(antecedent) of the item combinations that ``min_support`` of the rows (items, block) have with a block."""
    items = F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(rows.select(items.alias("items")))
    return model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("antecedent"))


def match(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_key): the rules (rule_key, antecedent) that each of the distinct ``baskets`` (key, items) fulfils.

    Inverted index: each rule is filed under its rarest item, each basket is looked up by
    its items, and the rest of the rule is then verified.
    """
    each = baskets.select("key", "items", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("df"))
    filed = (rules.select("rule_key", "antecedent", F.explode("antecedent").alias("item")).join(often, "item")
             .groupBy("rule_key").agg(F.min_by("item", F.struct("df", "item")).alias("item"), F.first("antecedent").alias("antecedent")))
    return each.join(materialise(filed, "url-index"), "item").where(F.size(F.array_except("antecedent", "items")) == 0).select("key", "rule_key")


def judge(pages: DataFrame, *, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, label: Column | None = None, fold: Column | None = None,
          min_support: float = 0.005, min_count: int = 5, min_confidence: float = 0.8, min_lift: float = 1.1) -> DataFrame:
    """All columns that the caller selects from: ``_in`` (the input row), host, path, rule, verdict, confidence, lift, precision.

    A fixed rule decides where one fits.  Other URLs are blocked if a mined rule holds
    for them, else allowed.  ``label`` is a boolean column (true: block; null:
    unlabelled) of ``pages``, with ``fold`` as its folds (four by hash of the URL, if not
    given); by default the fixed rules' verdicts serve as labels and their regions as folds.

    A mined rule needs ``min_support`` of the labelled rows and ``min_count`` of them, at
    ``min_confidence``, ``min_lift`` times as often a block as all labelled rows, and the
    same confidence (``precision``) on ``min_count`` rows of folds that it can be learned
    without and that hold labelled rows of both verdicts; where no fold does, nothing is
    mined.  Of several rules the most confident is reported.  Every token takes part
    in matching; tokens that always come together are mined as one, so a URL of very many
    tokens adds no combinations of its own.

    Null and malformed URLs have empty host and path, no tokens and are allowed.  Very
    long URLs are taken whole.  Repeated rows repeat, and count as often; an empty table
    or one without labelled rows mines nothing; other columns pass in ``_in``.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    own = F.lit(None).cast("string") if label is None else (F.pmod(F.crc32(F.coalesce(F.col(url), F.lit("")).cast("binary")), F.lit(4)) if fold is None else fold).cast("string")
    p = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "html"]).alias("_in"), F.col(url).alias("_url"), host.alias("host"), path.alias("path"),
                     (F.lit(None).cast("boolean") if label is None else label).alias("_label"), own.alias("_fold"))
    p = p.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("_region", region(F.col("host"), F.col("path"), rules)).withColumn("basket", tokens(F.col("_url"), F.col("host"), F.col("path")))
    p = p.withColumn("block", F.coalesce("_label", F.col("_rule.verdict") == "block")).withColumn("fold", F.coalesce("_fold", "_region", F.lit(""))).drop("_url", "_label", "_fold", "_region")
    p = materialise(p.withColumn("key", F.concat_ws("\x01", "basket")), "url-baskets")
    labelled = p.where(F.col("block").isNotNull() & (F.size("basket") > 0))
    bags = materialise(labelled.groupBy("key", "basket", "fold").agg(F.count("*").alias("n"), F.count_if("block").alias("b")), "url-bags")
    bags = bags.join(bags.groupBy("fold").agg(((F.sum("b") > 0) & (F.sum("b") < F.sum("n"))).alias("tests")), "fold")
    n_all, b_all = bags.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    least = max(min_count, -(-int(min_support * n_all * 1e9) // 10**9))
    items = materialise(token_items(bags, min_count=F.lit(least)), "url-items")
    distinct = p.where((F.col("block").isNotNull() & (F.size("basket") > 0)) | F.col("_rule").isNull()).select("key", "basket").distinct()
    baskets = distinct.select("key", F.explode("basket").alias("token")).join(items, "token").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    baskets = materialise(baskets, "url-item-baskets")
    rows = labelled.select("key", "block").join(baskets, "key").select("items", "block")
    if b_all and not items.isEmpty():
        mined = mine(rows, min_support=least / n_all)
    else:
        mined = spark.createDataFrame([], "antecedent array<string>")
    mined = materialise(mined.withColumn("rule_key", F.concat_ws("\x01", "antecedent")), "url-mined")
    hits = materialise(match(baskets, mined), "url-hits")
    stats = _counted(hits.join(bags.select("key", "fold", "tests", "n", "b"), "key"), "rule_key")
    stats = stats.withColumn("tried", _judged(F.col("folds"), F.col("n"), F.col("b"), F.lit(least), min_confidence))
    confidence, precision = F.col("b") / F.col("n"), F.col("tried.right") / F.col("tried.held")
    good = (F.col("b") >= min_confidence * F.col("n")) & (F.col("b") * float(n_all) >= min_lift * b_all * F.col("n")) & (F.col("tried.held") >= min_count) & (F.col("tried.right") >= min_confidence * F.col("tried.held"))
    kept = stats.where(good).select("rule_key", confidence.alias("confidence"), (confidence * n_all / max(b_all, 1)).alias("lift"), precision.alias("precision"))
    blocked = hits.join(kept, "rule_key").groupBy("key").agg(F.max(F.struct("confidence", "lift", "precision")).alias("why"))
    verdict = F.when(F.col("_rule").isNotNull(), F.col("_rule.verdict")).when(F.col("why").isNotNull(), "block").otherwise("allow")
    mined_only = lambda c: F.when(F.col("_rule").isNull(), F.col(f"why.{c}")).alias(c)
    return p.join(materialise(blocked, "url-blocked"), "key", "left").select("_in", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), *map(mined_only, ("confidence", "lift", "precision")))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("_in.page_id", "host", "path", "rule", "verdict", "confidence", "lift", "precision")
