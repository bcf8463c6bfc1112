"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Folders of intermediate tables, until they are discarded.
_WRITTEN: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset (tests on a local master) a temporary folder is made once;
    on a cluster an unset folder is an error, as executors share no local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="plumbline-")
    return f"file://{_LOCAL[app]}"


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a re-computation.  The
    folder stays until ``discard`` or ``clear`` deletes it.  ``by`` is a column whose
    values get folders of their own, so a filter on it reads no other rows.
    """
    path = new_folder(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.intermediate_path = path
    _WRITTEN.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "intermediate_path", None):
            _delete(df.sparkSession, path)
            if path in _WRITTEN:
                _WRITTEN.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this process.

    Results are lazy and read these tables, so call it once they are written elsewhere.
    """
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
