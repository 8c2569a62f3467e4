"""Tables that outlive one plan, kept where every executor and the driver can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="strandline-"))
    return "file://" + _own_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; what is written there is deleted when the driver's JVM ends."""
    own = f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}"
    if own not in _folders:
        make_folder(spark, own)
        where, fs = _hadoop(spark, own)
        fs.deleteOnExit(where)
        _folders.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, path: str) -> None:
    where, fs = _hadoop(spark, path)
    fs.mkdirs(where)


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """Copy one file, between any two file systems that Hadoop knows; its folder is made."""
    (a, fs_a), (b, fs_b) = _hadoop(spark, source), _hadoop(spark, target)
    fs_b.mkdirs(b.getParent())
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts lineage in a way that survives lost executors; unlike a checkpoint it is columnar, so
    later plans prune columns and know the table's size.  Deleted by ``release`` or when the driver's JVM
    ends.  Shuffle files of the plan that made it are released as soon as the driver's collector runs.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made, once all that reads them is itself written."""
    for t in tables:
        where, fs = _hadoop(t.sparkSession, t._written_at)
        fs.delete(where, True)


def numbered(rows: DataFrame, column: str, first: int, name: str) -> tuple[DataFrame, int]:
    """``rows``, written, with ``column``: numbers from ``first`` without gaps, in the order of the rows; and how many there are.

    A number is a row's place in its task behind the rows of the tasks before (one number a task).  What is written can be
    released like a table of ``materialize``.
    """
    rows = materialize(rows.withColumn("__at", F.monotonically_increasing_id()), name)
    task, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.task: r.n for r in rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()}
    before, n = [], first
    for t in sorted(counts):
        before.append((t, n))
        n += counts[t]
    starts = rows.sparkSession.createDataFrame(before, "__task long, __start long")
    out = rows.join(F.broadcast(starts), task == F.col("__task")).withColumn(column, F.col("__start") + place).drop("__at", "__task", "__start")
    out._written_at = rows._written_at
    return out, n - first


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as the session has cores, where they come in fewer (a file of one row group); else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body (or a lambda in it) names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
