"""Helpers the training-data operators share: shared-folder tables, table access, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when they start from another folder."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, known), ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without that setting a temporary one, on a local master only:
    machines of a cluster do not share such a folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="swaralens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back, which cuts its lineage.

    Lost executors cost nothing that was written. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/swaralens-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes what materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if hadoop.getName().startswith("swaralens-"):
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch, column: str = "text") -> list[str]:
    """The texts of an Arrow batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def crc_mod3(column) -> F.Column:
    return F.crc32(column.cast("string")) % 3
