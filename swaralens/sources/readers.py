"""Readers with fixed schemas: nothing is inferred, and missing columns are told at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, tokens

MANIFEST = "user_id long, recording_id long, language string, duration double, rec_url_gcp string, transcription_url string, metadata_url string"
PAIRS = "utt_id long, raw_asr string, reference string"
SHEET_KEYS = ("user_id", "recording_id", "language", "duration", "rec_url_gcp")


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all machines share; without that setting a
    temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="swaralens-")
    path = f"{base.rstrip('/')}/swaralens-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of recordings, one or more files of them."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of {raw_asr, reference}; a missing reference is empty. utt_id is a row's place in its
    file, or its own utt_id."""
    rows = spark.read.text(path, wholetext=True)
    each = rows.select(F.posexplode(F.from_json("value", "array<struct<utt_id:bigint,raw_asr:string,reference:string>>")).alias("idx", "p"))
    return each.select(F.coalesce("p.utt_id", F.col("idx").cast("long")).alias("utt_id"), "p.raw_asr", F.coalesce("p.reference", F.lit("")).alias("reference"))


def read_lattice_input(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {reference, models: {name: text}} a file -> (utt_id, reference, model_ord, model,
    hyp), with the models in the object's own order."""
    rows = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.reference").alias("reference"), F.from_json(F.get_json_object("value", "$.models"), "map<string,string>").alias("models"))
    rows = rows.select(F.monotonically_increasing_id().alias("utt_id"), "reference", F.posexplode(F.map_entries("models")).alias("model_ord", "m"))
    return rows.select("utt_id", F.when(F.col("reference").isNull(), F.raise_error(F.lit("reference is missing"))).otherwise(F.col("reference")).alias("reference"), "model_ord", F.col("m.key").alias("model"), F.col("m.value").alias("hyp"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON report; None where there is none."""
    return spark.read.option("multiLine", True).json(path) if _exists(spark, path) else None


def report_status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(name, _exists(spark, path)) for name, path in paths.items()], "report string, present boolean")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; only empty fields are null, so that words like 'NA' stay words."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stripped lines as `word`, exactly as they are written."""
    return spark.read.text(path).select(strip("value").alias("word")).where("word <> ''").distinct()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def corpus_words(corpus: DataFrame, line: str = "line") -> DataFrame:
    return corpus.select(F.explode(tokens(line)).alias("word"))


def classify_sheets(sheets: dict[str, list[str]]) -> dict[str, str]:
    """Which sheet (name -> header) holds words, recordings and model outputs; the last fit wins."""
    found: dict[str, str] = {}
    for name, header in sheets.items():
        names = {str(h).strip() for h in header if h is not None}
        if "word" in names:
            found["words"] = name
        if names.issuperset(SHEET_KEYS):
            found["recordings"] = name
        if "Human" in names and any(h.startswith("Model ") for h in names):
            found["models"] = name
    missing = {"words", "recordings", "models"} - set(found)
    if missing:
        raise ValueError(f"no sheet for: {', '.join(sorted(missing))}")
    return found


def extract_urls(rows: DataFrame, column: str | Column) -> DataFrame:
    """Distinct web addresses within a text column, sorted."""
    source = F.col(column) if isinstance(column, str) else column
    urls = F.regexp_extract_all(source, F.lit(r"""(https?://[^\s)\]>"']+)"""), F.lit(1))
    return rows.select(F.explode(urls).alias("url")).distinct().orderBy("url")


def sheet_exports(urls: DataFrame, host: str) -> DataFrame:
    """(sheet_id, export_url) of the sheet addresses of a host among url."""
    ids = urls.where(F.contains("url", F.lit(host))).select(F.regexp_extract("url", "/d/([^/]+)/", 1).alias("sheet_id")).where("sheet_id <> ''")
    return ids.select("sheet_id", F.concat(F.lit(f"https://{host}/d/"), "sheet_id", F.lit("/export?format=xlsx")).alias("export_url"))


def rewrite_manifest(sheet: DataFrame, base: str) -> DataFrame:
    """Manifest rows from sheet rows: addresses under base/<folder>, the folder being the one before
    last in the old address. Rows without an id or folder are left out; a missing language is 'hi',
    a missing duration 0."""
    rows = require_columns(sheet, SHEET_KEYS).where(F.col("recording_id").isNotNull())
    path = F.regexp_replace(F.regexp_extract(strip(F.coalesce("rec_url_gcp", F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "^/+|/+$", "")
    parts = F.split(path, "/")
    rows = rows.withColumn("_folder", F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))).where("_folder <> ''")
    rid = F.col("recording_id").cast("long")
    address = lambda end: F.concat(F.lit(base.rstrip("/") + "/"), "_folder", F.lit("/"), rid.cast("string"), F.lit(end))
    return rows.select(
        F.col("user_id").cast("long").alias("user_id"), rid.alias("recording_id"), F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("hi")).alias("language"),
        F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("duration"), address("_audio.wav").alias("rec_url_gcp"), address("_transcription.json").alias("transcription_url"), address("_metadata.json").alias("metadata_url"),
    )
