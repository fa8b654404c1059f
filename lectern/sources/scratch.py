"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where none is named, a temporary one serves a local session; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lectern-")
        shared_dir.own = named
    return named.rstrip("/")


def materialise(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for t in tables:
        if at := getattr(t, "_written_at", None):
            jvm, spark = t.sparkSession._jvm, t.sparkSession
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: its cleaner acts when the driver collects garbage."""
    spark._jvm.java.lang.System.gc()
