"""Sessions, and tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def session(master: str | None = None, name: str = "strandloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a new local folder if all tasks run in this process, else one in the warehouse, unless that is a local folder too, which machines don't share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            found = f"file://{tempfile.mkdtemp(prefix='strandloom-')}"
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if re.match("file:|/", warehouse):
                raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; the warehouse is local ({warehouse})")
            found = f"{warehouse}/strandloom-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write the table to the shared folder and read it back: lineage ends here, and a lost executor costs nothing.  ``codec``: by default, the session's."""
    path = new_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    fs, at = _at(spark, path)
    return fs.exists(at)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches."""
    fs, at = _at(spark, pattern)
    return bool(fs.globStatus(at))


def publish(table: DataFrame | dict[str, DataFrame], path: str) -> None:
    """Writes a table to a path that many drivers may write at once: the first whole one stays.  Of several tables, named by folders below the path, all appear at once."""
    tables = {"": table} if isinstance(table, DataFrame) else table
    spark = next(iter(tables.values())).sparkSession
    parent, _, name = path.rpartition("/")
    own = f"{parent}/_{name}-{uuid.uuid4().hex}"  # not a table's folder, by its name
    for part, df in tables.items():
        df.write.parquet(f"{own}/{part}".rstrip("/"))
    fs, at = _at(spark, own)
    if exists(spark, path) or not fs.rename(at, _at(spark, path)[1]):
        fs.delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``cut`` has written for tables that nothing reads any more."""
    for t in tables:
        if path := _written.pop(t, None):
            fs, at = _at(t.sparkSession, path)
            fs.delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows of a source that has fewer splits than the cluster has cores to all cores; other sources stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
