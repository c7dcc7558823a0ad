"""The row-wise functions on streams, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import clean_pipeline
from ..functions.spell import classify, normal_word
from ..sources.readers import scratch


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """New Parquet files in a folder; for the path of a single file, that file."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", hadoop.getName()).parquet(hadoop.getParent().toString())
    return reader.parquet(path)


def clean_stream(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds normalized, tagged and english_words; stateless."""
    return rows.withColumn("_c", clean_pipeline(text)).select(*rows.columns, "_c.normalized", "_c.tagged", "_c.english_words")


def spell_stream(rows: DataFrame, word: str = "word") -> DataFrame:
    return rows.withColumn("_w", normal_word(word)).withColumn("_j", classify("_w")).select(*rows.columns, "_j.*")


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key. State is kept until the watermark has passed a window."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Processes all that is there into a written table under the scratch folder and reads it. A batch
    that is run again replaces its own files."""
    spark = stream.sparkSession
    path = scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table" if mode == "complete" else f"{path}/table/batch={number}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
    query = writer.option("checkpointLocation", checkpoint or f"{path}/checkpoint").start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/table").select(*stream.columns)
