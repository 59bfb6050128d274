"""Reading the input tables and cutting lineage where all executors can see the result."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK_DIR = "/tmp/checkpoints"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by whatever file system the folder's path names."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one where none is named and the executors are this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{FALLBACK_DIR}/{os.getpid()}"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut`, by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package when it is run from a folder that isn't on their path."""
    import lexgraph

    root = os.path.dirname(os.path.dirname(os.path.abspath(lexgraph.__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    return spark


def row_key(*parts: Column) -> Column:
    """128 bits that identify a row by its values, nulls included: rows with equal values share it, others don't. Each value is digested by itself, so no separator can be forged."""
    digests = [F.coalesce(F.md5(x.cast("string").cast("binary")), F.lit("null")) for x in parts]
    whole = F.unhex(F.md5(F.concat_ws(":", *digests).cast("binary")))
    return F.coalesce(whole, F.lit("").cast("binary"))  # never null, and known not to be: joins add no filter, so equal exchanges of texts stay one


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of the first match each, so that extra or clashing columns never matter."""
    return df.select(*[df[source].alias(target) for target, source in columns.items()])
