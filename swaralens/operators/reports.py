"""Reports: error taxonomy, fixes, before/after evaluations, and their sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.english import clean_pipeline, has_idiom, is_code_mixed, roman_to_devanagari, strip_tags
from ..functions.lexicons import CATEGORIES, OTHER_CATEGORY, literal_map
from ..functions.metrics import corpus_wer, relative_reduction
from ..functions.text import round_even, title_id


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Frequencies of the values of a column, nulls left out; most frequent first, ties by value."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def taxonomy(errors: DataFrame, examples: int = 5) -> DataFrame:
    """(rank, id, name, frequency, frequency_pct, description, examples) from errors (idx, category,
    reference, hypothesis, root_cause). A null category is counted as 'nan'."""
    rows = errors.withColumn("id", F.coalesce(F.col("category").cast("string"), F.lit("nan")))
    counts = rows.groupBy("id").agg(F.count("*").alias("frequency"))
    total = rows.agg(F.count("*").alias("total"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("idx"))).where(F.col("_k") <= examples)
    shown = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_k"), text("reference").alias("reference"), text("hypothesis").alias("output"), text("root_cause").alias("cause")))), lambda e: F.struct(e["reference"].alias("reference"), e["output"].alias("output"), e["cause"].alias("cause"))).alias("examples"))
    about = F.coalesce(F.try_element_at(literal_map({k: v[0] for k, v in CATEGORIES.items()}), F.col("id")), F.lit(OTHER_CATEGORY[0]))
    # Categories of one frequency are ranked by id behind all of a higher one. Distinct frequencies are
    # at most the square root of twice the errors.
    above = Window.orderBy(F.desc("frequency")).rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("frequency").agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).drop("_n")
    rows = counts.join(classes, "frequency").crossJoin(total).join(shown, "id", "left")  # one row of totals
    rank = F.col("_above") + F.row_number().over(Window.partitionBy("frequency").orderBy("id"))
    return rows.select(rank.cast("int").alias("rank"), "id", title_id("id").alias("name"), "frequency", round_even(F.col("frequency") / F.col("total") * 100, 2).alias("frequency_pct"), about.alias("description"), "examples")


def top_fixes(categories: DataFrame, k: int = 3) -> DataFrame:
    """A fix for each of the first k categories."""
    field = lambda at, other: F.coalesce(F.try_element_at(literal_map({c: v[at] for c, v in CATEGORIES.items()}), F.col("id")), other)
    name = F.format_string(OTHER_CATEGORY[1].replace("{}", "%s"), "id")
    return categories.where(F.col("rank") <= k).select("rank", field(1, name).alias("fix_name"), F.col("id").alias("target_errors"), field(2, F.lit(OTHER_CATEGORY[2])).alias("approach"), F.col("frequency_pct").alias("potential_impact_pct"), field(3, F.lit(OTHER_CATEGORY[3])).alias("effort"))


def fix_evaluation(pairs: DataFrame) -> DataFrame:
    """Word error rate of the code-mixed pairs (reference, hypothesis) before and after Roman words are
    rewritten; nulls if there are none."""
    mixed = pairs.where(is_code_mixed("hypothesis"))
    rates = mixed.agg(F.count("*").alias("n"), corpus_wer("reference", "hypothesis").alias("before"), corpus_wer("reference", roman_to_devanagari("hypothesis")).alias("after"))
    return rates.select("n", round_even("before", 2).alias("wer_before"), round_even("after", 2).alias("wer_after"), round_even(F.col("before") - F.col("after"), 2).alias("gain"))


def fix_examples(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The first k pairs (idx, reference, hypothesis) that rewriting changes."""
    rows = pairs.where(is_code_mixed("hypothesis")).withColumn("fixed", roman_to_devanagari("hypothesis"))
    return rows.where(F.col("fixed") != F.col("hypothesis")).orderBy("idx").limit(k)


def cleanup_rows(pairs: DataFrame) -> DataFrame:
    """Pairs (utt_id, raw_asr, reference) with normalized, tagged, english_words and cleaned."""
    rows = pairs.withColumn("c", clean_pipeline("raw_asr")).select("utt_id", "raw_asr", F.coalesce("reference", F.lit("")).alias("reference"), "c.normalized", "c.tagged", "c.english_words")
    return rows.withColumns({"cleaned": strip_tags("tagged"), "has_idiom": has_idiom("raw_asr"), "changed": F.col("raw_asr") != F.col("normalized")})


def cleanup_evaluation(rows: DataFrame) -> DataFrame:
    """Word error rate of cleanup_rows() before and after, rounded, and the difference."""
    rates = rows.agg(F.count("*").alias("n"), corpus_wer("reference", "raw_asr").alias("before"), corpus_wer("reference", "cleaned").alias("after"))
    return rates.select("n", round_even("before", 2).alias("wer_before"), round_even("after", 2).alias("wer_after"), round_even(F.col("before") - F.col("after"), 2).alias("delta"))


def cleanup_examples(rows: DataFrame, numbers: int = 5, idioms: int = 3, english: int = 5) -> DataFrame:
    """The first rows of each kind, in order of utt_id: changed numbers, idioms, English words. Rows are
    worked out once for all kinds, and a task passes on no more than the first of each."""
    kinds = {"number": ("changed", numbers), "idiom": ("has_idiom", idioms), "english": ("_english", english)}
    marked = rows.withColumn("_english", F.size("english_words") > 0)
    each = marked.select(F.explode(F.array(*(F.when(F.col(c), kind) for kind, (c, _) in kinds.items()))).alias("kind"), "utt_id", "raw_asr", "normalized", "tagged", "english_words").where("kind is not null")
    turn = F.row_number().over(Window.partitionBy("kind").orderBy("utt_id"))
    first = each.withColumn("_k", turn).where(F.col("_k") <= max(k for _, k in kinds.values()))
    most = F.element_at(literal_map({kind: k for kind, (_, k) in kinds.items()}), F.col("kind"))
    return first.where(F.col("_k") <= most).drop("_k")


def wer_table(rates: DataFrame) -> DataFrame:
    """(model, wer, relative_reduction) from (ord, model, wer): the reduction against the first row."""
    first = rates.orderBy("ord").limit(1).select(F.col("wer").alias("base"))
    return rates.crossJoin(first).select("model", "wer", round_even(relative_reduction(F.col("base"), F.col("wer")), 2).alias("relative_reduction"))  # one row


def _field(report: DataFrame | None, paths: list[str], other: Column) -> Column:
    """The first of some dotted paths that a report has, or another value."""
    found = [F.col(f"_report.{p}") for p in paths if report is not None and has_path(report, p)]
    return F.coalesce(*found, other) if found else other


def submission_report(errors: DataFrame, existing: DataFrame | None = None, source: str = "error_samples.csv") -> DataFrame:
    """One row, the whole report: results, sampling, taxonomy, top fixes and the evaluated fix, from
    errors (idx, category, reference, hypothesis, root_cause, severity) and what an existing report of
    one row holds. The rates of the evaluated fix may stand under implemented_fix.results or directly
    under implemented_fix. Only tables of a row a category or severity are gathered."""
    known = taxonomy(errors)
    fields = ("id", "name", "frequency", "frequency_pct", "description", "examples")
    ranked = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    categories = known.agg(F.transform(ranked, lambda c: F.struct(*(c[f].alias(f) for f in fields))).alias("categories"))
    fixes = top_fixes(known).agg(F.array_sort(F.collect_list(F.struct("rank", "fix_name", "target_errors", "approach", "potential_impact_pct", "effort"))).alias("top_fixes"))
    levels = value_counts(errors, "severity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severities"))
    total = errors.agg(F.count("*").alias("total"))
    rows = total.crossJoin(categories).crossJoin(fixes).crossJoin(levels)  # one row each
    if existing is not None:
        rows = rows.crossJoin(existing.limit(1).select(F.struct(*existing.columns).alias("_report")))
    take = lambda paths, other: _field(existing, paths, other)
    rate = lambda name: take([f"implemented_fix.results.{name}", f"implemented_fix.{name}"], F.lit(None).cast("double")).alias(name)
    fix = F.struct(
        take(["implemented_fix.name"], F.lit("Not yet evaluated")).alias("name"), take(["implemented_fix.target_subset_size"], F.lit(0)).cast("long").alias("target_subset_size"),
        rate("wer_before"), rate("wer_after"), rate("delta_pp"),
    )
    taxonomy_ = F.struct("categories", F.size("categories").alias("total_error_categories"))
    sampling = F.struct(F.col("total").alias("total_error_samples"), F.lit(source).alias("error_samples_csv"), F.col("severities").alias("severity_distribution"))
    results = take(["results"], F.array().cast("array<string>"))
    return rows.select(
        take(["dataset"], F.lit("Live Hindi ASR evaluation")).alias("dataset"), take(["metric"], F.lit("Word Error Rate (WER %)")).alias("metric"), results.alias("results"), sampling.alias("sampling"),
        taxonomy_.alias("error_taxonomy"), F.col("top_fixes"), F.col("top_fixes").alias("proposed_fixes"), fix.alias("implemented_fix"), fix.alias("implementation_results"),
    )


def has_path(report: DataFrame, path: str) -> bool:
    """Whether a report's schema has a dotted path."""
    kind = report.schema
    for part in path.split("."):
        if part not in getattr(kind, "names", []):
            return False
        kind = kind[part].dataType
    return True


def completeness(report: DataFrame, keys: list[str]) -> DataFrame:
    """(key, present) for dotted paths of a one-row report."""
    return report.sparkSession.createDataFrame([(k, has_path(report, k)) for k in keys], "key string, present boolean")


def write_csv(rows: DataFrame, path: str, order: str | None = None) -> None:
    """CSV with a header; with an order, one file in that order."""
    (rows.orderBy(order).drop(order).coalesce(1) if order else rows).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON object; null fields are kept. Tables go to write_array()."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_array(rows: DataFrame, path: str) -> None:
    """JSON files that each hold an array of objects, null fields included: what the array readers take."""

    def run(batches):
        between = "["
        for batch in batches:
            lines = []
            for row in batch.column("value").to_pylist():
                lines.append(between + row)
                between = ","
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if between == "[" else "]"], pa.string())], names=["value"])

    as_json = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    as_json.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
