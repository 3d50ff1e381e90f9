"""Intermediate tables in the folder that all executors share: lineage is cut by writing and reading again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """
    The folder that spark.checkpoint.dir names. Where it is unset, a session on one machine gets a temporary folder; on
    a cluster such a folder would be seen by one machine only, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-"))
    return (found or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """
    Cuts the lineage: writes `df` to the shared folder as Parquet and reads it again. discard() removes it. `options` of the writer.
    Nobody waits for these tables, so they get no marker _SUCCESS: for that file, on local disks, Hadoop starts processes
    (chmod) from the driver, each of which has the driver's memory as its own until it runs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsloom-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def deleted(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    fs, at = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, found in one call."""
    fs, at = _at(spark, pattern)
    return [f.getPath().toString() for f in fs.globStatus(at) or []]


def discard(*tables: DataFrame) -> None:
    """Removes what stored() wrote. Only for tables that nothing reads any more, not even a lazy result."""
    for t in tables:
        deleted(t.sparkSession, t.stored_at)


def spread(df: DataFrame) -> DataFrame:
    """
    Deals rows out where the input has less than half as many splits as there are cores, as one small file has; others stay
    as they are, and so do inputs with shuffles of their own, which would have to run to tell.
    """
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
