"""Secret scan with corpus-wide ownership frequency (operator 1, native).

Main path: DataFrame functions only.  Candidate strings are found in every whole
text, hashed, and counted over the corpus by distinct repositories and distinct
owners, those of every copy of a text among them.  A string that many owners or many
repositories carry is a copied example; one that a single owner or a single text carries
in few looks like a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import materialise, read

# Fixed patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs, so the same as [0-9a-f]+ kept at 24 characters or more
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"  # the method's own candidates

KINDS = ("assign", "access", "hex", "opaque")
_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
_DOC = ("repo", "owner", "key")
_MOST = ("n_repos", "all_repos", "all_owners")


def _matches(text: Column, pattern: str, value_group: int, rank: int, keep) -> Column:
    """All leftmost non-overlapping matches: rank, number, code points of the gap before and of the match, the value's hash.

    ``split`` gives the gaps between the matches; positions are running sums over gaps
    and matches.  ``keep(match, value)`` marks those that count.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value"),
    )
    length = lambda x: F.char_length(x).cast("long")
    made = F.transform(found, lambda x, k: F.struct(F.lit(rank).alias("rank"), k.alias("n"), length(x["gap"]).alias("gap"), length(x["whole"]).alias("len"),
                                                   keep(x["whole"], x["value"]).alias("ok"), F.xxhash64(x["value"]).alias("hash")))
    return F.when(text.rlike(pattern), F.slice(made, 1, F.size(made) - 1)).otherwise(F.slice(made, 1, 0))  # the last gap has no match


def candidates(docs: DataFrame, text: str, repo: str, owner: str) -> DataFrame:
    """(repo, owner, key, found): all matches of each row.  ``key`` tells rows of one repo apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    yes = lambda whole, value: F.lit(True)
    mixed = lambda w, v: w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    d = docs.select(F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.xxhash64(body).alias("key"), body.alias("body"))
    return d.select(*_DOC, F.concat(
        _matches(F.col("body"), ASSIGN, 2, 0, lambda w, v: F.char_length(v) >= 6), _matches(F.col("body"), ACCESS, 0, 1, lambda w, v: F.char_length(w) >= 20),
        _matches(F.col("body"), HEX, 0, 2, yes), _matches(F.col("body"), OPAQUE, 0, 3, mixed)).alias("found"))


def spans(cands: DataFrame) -> DataFrame:
    """(repo, owner, key, rank, start, end, hash): base spans, and opaque ones that touch none of them.

    Spans of one row are placed by window sums over its own matches, so a very long row
    costs in proportion to its matches.
    """
    each = cands.where(F.size("found") > 0).dropDuplicates(list(_DOC)).select(*_DOC, F.explode("found").alias("x")).select(*_DOC, "x.*")
    running = Window.partitionBy(*_DOC, "rank").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(running)).withColumn("start", F.col("end") - F.col("len")).where("ok")
    row = Window.partitionBy(*_DOC).orderBy("start", "rank")
    base = F.col("rank") < 3
    before = F.max(F.when(base, F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy(*_DOC).orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return placed.withColumn("free", base | free).where("free").select(*_DOC, "rank", "start", "end", "hash")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners, all_repos, all_owners): each candidate string by distinct repositories and owners.

    ``all_repos`` and ``all_owners`` are those of every row, copies of a text among them;
    a text without a repository is one of its own.  ``n_repos`` and ``n_owners`` are at
    most the number of distinct texts, so that the copies of one text count once,
    whichever rows they stand in.  All aggregations are combined before their shuffle, so
    a string that a third of all rows carry sends a few rows per task, not one per
    occurrence.
    """
    def distinct(name: str, *of) -> DataFrame:
        return found.groupBy("hash", *of).agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias(name))

    repos = distinct("all_repos", "repo", F.when(F.col("repo").isNull(), F.col("key")).alias("own"))
    owners = found.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count_if(F.col("owner").isNotNull()).alias("all_owners"))
    every = repos.join(owners, "hash").join(distinct("n_texts", "key"), "hash")
    return every.select("hash", F.least("all_repos", "n_texts").alias("n_repos"), F.least("all_owners", "n_texts").alias("n_owners"), "all_repos", "all_owners")


def scan(docs: DataFrame, *, text: str = "text", repo: str = "doc_id", owner: str = "source", live_owners: int = 1, copied_owners: int = 3, copied_repos: int = 20) -> DataFrame:
    """One row per input row: repo, base and all spans in order, and how its strings are owned.

    A string known to ``copied_owners`` owners or more, or in ``copied_repos`` repositories
    or more, counts as a copied example, whether texts of their own or copies of one text
    carry it.  Any other counts as live if at most ``live_owners`` owners, or as many
    distinct texts, carry it.  Opaque tokens become spans only when live; base spans always
    stay.  ``n_repos`` is the most repositories that one string of the row is in, copies of
    a text once; ``all_repos`` and ``all_owners`` count every copy.

    Very long texts are scanned whole, at a cost in proportion to their length.  Spans of
    one start are ordered by kind.
    Null text is empty text; a null owner owns nothing, so its strings count no owner
    and stay live in few repositories.  Repeated rows give repeated results and count once in the
    frequencies.  Empty tables give empty results; extra columns are not read.
    """
    c = materialise(candidates(docs, text, repo, owner), "secret-candidates")
    found = materialise(spans(c), "secret-spans")
    owned = materialise(ownership(found), "secret-ownership")  # a plain shuffle, so that the rows of a string that very many texts carry are split
    copied = (F.col("all_owners") >= copied_owners) | (F.col("all_repos") >= copied_repos)
    judged = found.join(owned, "hash").withColumns({"live": (F.col("n_owners") <= live_owners) & ~copied, "copied": copied})
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    span = F.struct("start", "rank", "end", kind.alias("kind"))
    per_row = judged.groupBy(*[F.col(x).alias(f"_{x}") for x in _DOC]).agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") < 3, span))).alias("base"), F.array_sort(F.collect_list(F.when((F.col("rank") < 3) | F.col("live"), span))).alias("all"),
        F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"), *[F.max(x).alias(x) for x in _MOST])
    same = c["repo"].eqNullSafe(per_row["_repo"]) & c["owner"].eqNullSafe(per_row["_owner"]) & (c["key"] == per_row["_key"])
    none, zero = F.array().cast(f"array<{_SPAN}>"), F.lit(0).cast("long")
    return c.select(*_DOC).join(per_row, same, "left").select(
        "repo", F.coalesce("base", none).alias("base"), F.coalesce("all", none).alias("all"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"), *[F.coalesce(x, zero).alias(x) for x in _MOST])


def _joined(of: Column) -> Column:
    return F.concat_ws(",", F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; the source is the owner, the document the repository."""
    s = scan(read(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return s.select(
        F.col("repo").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), "n_live", "n_copied", *_MOST)
