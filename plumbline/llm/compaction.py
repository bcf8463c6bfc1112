"""Sharding with size-tiered compaction (operator 2, native).

Data and statistics move through DataFrame reads and writes only.  A store is a folder
of immutable runs and numbered manifests; a manifest lists the shards that make up one
version, and appears under its number by one rename, which the store's file system must
make whole or not at all (HDFS and POSIX do; on plain object stores use a connector with
an atomic rename).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import new_folder, read, unused

_MANIFEST = "run string, shard string, bytes long, rows long, merges int"


class ShardStore:
    """Size-tiered runs of Parquet shards under ``root``.

    ``fan_in`` runs of similar size (each within half to one and a half times their mean)
    are merged into one run of files of about ``target_bytes``.  Readers see one version
    whole: files of later or failed writes are in no manifest.  Writers may race: the
    loser of a version tries again on the winner's.
    """

    def __init__(self, spark: SparkSession, root: str, *, schema, target_bytes: int = 128 << 20, fan_in: int = 4):
        self.spark, self.root, self.schema, self.target_bytes, self.fan_in = spark, root, schema, target_bytes, fan_in
        # scans of this session pack whole small files into partitions of the target size, so a merge needs no shuffle
        self._packing = spark.newSession()
        for k, v in {"maxPartitionBytes": str(target_bytes), "openCostInBytes": "0", "minPartitionNum": "1"}.items():
            self._packing.conf.set(f"spark.sql.files.{k}", v)

    # Versions

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifest")
        return sorted(int(x.getPath().getName()[1:]) for x in self._fs().listStatus(at) if x.getPath().getName().startswith("v")) if self._fs().exists(at) else []

    def latest(self) -> int:
        """The last version; 0 is the empty one before any commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(run, shard, bytes, rows, merges) of a version, the latest by default."""
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v{version:08d}")

    def _commit(self, manifest: DataFrame, after: int) -> int:
        """Publish ``manifest`` as the version after ``after``.  Of two writers, the later rename fails."""
        aside = f"{self.root}/manifest/_{uuid.uuid4().hex}"
        manifest.write.parquet(aside)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._path(aside), self._path(f"{self.root}/manifest/v{after + 1:08d}"), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            self._fs().delete(self._path(aside), True)
            raise
        return after + 1

    def _committed(self, change: Callable[[DataFrame], DataFrame | None]) -> int | None:
        """Commit ``change`` of the latest manifest, again and again until no other writer comes between; None if it no longer applies."""
        while True:
            after = self.latest()
            new = change(self.manifest(after))
            if new is None:
                return None
            try:
                return self._commit(new, after)
            except Py4JJavaError:
                if self.latest() == after:  # not a lost race
                    raise

    # Runs

    def _listed(self, run: str, merges: int) -> DataFrame:
        """Manifest rows of a written run, from the files' own metadata; no column is read."""
        files = self.spark.read.schema(self.schema).parquet(self._folder(run))
        per = files.groupBy(files.metadataColumn("_metadata")["file_path"].alias("shard"), files.metadataColumn("_metadata")["file_size"].alias("bytes")).agg(F.count("*").alias("rows"))
        return per.select(F.lit(run).alias("run"), "shard", "bytes", "rows", F.lit(merges).alias("merges"))

    def _folder(self, run: str) -> str:
        return f"{self.root}/{run}"

    def append(self, arrivals: DataFrame) -> int:
        """Write arrivals as one run of small shards and commit it."""
        run = uuid.uuid4().hex
        arrivals.select(*[F.col(f"`{f.name}`") for f in self.schema]).write.option("compression", "zstd").parquet(self._folder(run))
        listed = self._listed(run, 0)
        return self._committed(lambda old: old.unionByName(listed))

    def due(self) -> list[str] | None:
        """The runs of the smallest tier that has ``fan_in`` of them.  Reads one row per run."""
        return full_tier(((r["run"], r["bytes"]) for r in self.manifest().groupBy("run").agg(F.sum("bytes").alias("bytes")).collect()), self.fan_in)

    def merge(self, runs: list[str]) -> int | None:
        """Rewrite ``runs`` as one run of target-sized files and commit; None if another writer has merged one of them meanwhile."""
        run = uuid.uuid4().hex
        merges = 1 + (self.manifest().where(F.col("run").isin(runs)).agg(F.max("merges")).first()[0] or 0)
        self._packing.read.schema(self.schema).parquet(*map(self._folder, runs)).write.option("compression", "zstd").parquet(self._folder(run))
        listed = self._listed(run, merges)

        def change(old: DataFrame) -> DataFrame | None:
            there = old.where(F.col("run").isin(runs)).select("run").distinct().count() == len(runs)
            return old.where(~F.col("run").isin(runs)).unionByName(listed) if there else None

        version = self._committed(change)
        if version is None:
            self._fs().delete(self._path(self._folder(run)), True)
        return version

    def compact(self, keep: int = 2) -> int:
        """Merge until no tier is full; returns the version reached.

        The last ``keep`` versions stay readable throughout, so a reader of the version
        before is not broken.
        """
        while runs := self.due():
            self.merge(runs)
            self.vacuum(keep=keep)
        return self.latest()

    def vacuum(self, keep: int, orphans_after: float | None = None) -> None:
        """Delete the manifests before the last ``keep`` and the runs that only they list.

        ``orphans_after``: also runs and half-written manifests that no version lists and
        that are older than so many seconds; writers that died leave such.
        """
        versions = self.versions()
        runs = lambda v: {r["run"] for r in self.manifest(v).select("run").distinct().collect()}
        needed = set().union(*map(runs, versions[-keep:]))
        for v in versions[:-keep]:
            for run in runs(v) - needed:
                self._fs().delete(self._path(self._folder(run)), True)
            self._fs().delete(self._path(f"{self.root}/manifest/v{v:08d}"), True)
        if orphans_after is not None:
            before = (time.time() - orphans_after) * 1000
            for folder, known in ((self.root, {*needed, "manifest"}), (f"{self.root}/manifest", {f"v{v:08d}" for v in versions})):
                for x in self._fs().listStatus(self._path(folder)):
                    if x.getPath().getName() not in known and x.getModificationTime() < before:
                        self._fs().delete(x.getPath(), True)

    def read(self, version: int | None = None, shard: str = "_shard") -> DataFrame:
        """All rows of a version, each with the shard that holds it."""
        runs = [r["run"] for r in self.manifest(version).select("run").distinct().collect()]
        if not runs:
            return self.spark.createDataFrame([], self.schema).withColumn(shard, F.lit(None).cast("string"))
        rows = self.spark.read.schema(self.schema).parquet(*map(self._folder, sorted(runs)))
        return rows.select("*", rows.metadataColumn("_metadata")["file_path"].alias(shard))


def full_tier(runs: Iterable[tuple[str, int]], fan_in: int) -> list[str] | None:
    """Of (run, bytes), the ``fan_in`` runs of the smallest full tier, or None.

    From the smallest run up, a tier takes the next run if that is at most one and a half
    times their mean, and drops those under half of it.
    """
    tier: list[tuple[int, str]] = []
    for size, run in sorted((b, r) for r, b in runs):
        mean = (sum(b for b, _ in tier) + size) / (len(tier) + 1)
        if tier and size > 1.5 * mean:
            tier, mean = [], size
        tier = [x for x in tier if x[0] >= 0.5 * mean] + [(size, run)]
        if len(tier) == fan_in:
            return [r for _, r in tier]
    return None


#: Arrivals of the query.
ARRIVALS = 10


def op2_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, appended as ten arrivals, each a commit, and compacted: each row's digest, and the shard that holds it.

    Null ids and texts, very long texts, repeated rows and extra columns are stored as
    they are (a null id arrives first; ties are not ordered); an empty table commits
    versions without rows.
    """
    docs = read(spark, sf_dir, "documents")
    store = ShardStore(spark, new_folder(spark, "shards"), schema=docs.schema)
    arrival = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)), F.lit(0))
    for k in range(ARRIVALS):
        store.append(docs.where(arrival == k))
    version = store.compact()
    at = unused(docs, "_shard")
    rows = store.read(shard=at).select("doc_id", "source", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col(at).alias("shard"))
    listed = store.manifest(version).select("shard", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "merges")
    return rows.join(listed, "shard", "left").withColumn("version", F.lit(version))
