"""Deterministic samples and splits. Where pandas draws at random, a hash decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import cer, wer
from ..functions.text import round_even, strip, tokens

SEVERITIES = ("Low", "Medium", "High", "Severe")


def severity(rate: Column) -> Column:
    """By a rounded word error rate: (0, 25], (25, 50], (50, 75], (75, 101]; null elsewhere."""
    return F.when((rate > 0) & (rate <= 25), "Low").when((rate > 25) & (rate <= 50), "Medium").when((rate > 50) & (rate <= 75), "High").when((rate > 75) & (rate <= 101), "Severe")


def error_rows(pairs: DataFrame) -> DataFrame:
    """(idx, reference, predicted, wer, cer, ref_len, severity) of the pairs (idx, reference,
    predicted) that differ by more than surrounding blanks. Rates have one digit."""
    wrong = pairs.where(strip("reference") != strip("predicted"))
    rows = wrong.select("idx", "reference", "predicted", round_even(wer("reference", "predicted"), 1).alias("wer"), round_even(cer("reference", "predicted"), 1).alias("cer"), F.size(tokens("reference")).alias("ref_len"))
    return rows.withColumn("severity", severity(F.col("wer")))


def stratified_sample(errors: DataFrame, n: int = 50) -> DataFrame:
    """About n rows: from each severity, every so many by reference length and idx, at most a quarter each.

    Rows are counted by severity and length first. The wanted places lie in a few of these groups (at
    most a quarter of n a severity), and in each of them in a few blocks of ids; only
    rows of such blocks are ever sorted.
    """
    target = math.ceil(n / 4)
    rows = errors.where("severity is not null").withColumn("_r", _range("idx"))
    groups = rows.groupBy("severity", "ref_len", "_r").agg(F.count("*").alias("_n"))
    lengths = groups.groupBy("severity", "ref_len").agg(F.sum("_n").alias("_l"))
    by_length = Window.partitionBy("severity").orderBy("ref_len").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.withColumns({"_first": F.coalesce(F.sum("_l").over(by_length), F.lit(0)), "_m": F.sum("_l").over(Window.partitionBy("severity"))})
    step = F.greatest(F.lit(1), F.floor(F.col("_m") / target).cast("long"))
    # A span of places [first, first + count) holds a wanted one if a multiple of step below target x step is in it.
    wanted = lambda first, count: (F.ceil(first / F.col("_step")) * F.col("_step") < first + count) & (F.ceil(first / F.col("_step")) < target)
    lengths = lengths.withColumn("_step", step).where(wanted(F.col("_first"), F.col("_l")))
    by_range = Window.partitionBy("severity", "ref_len").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    spans = groups.join(lengths, ["severity", "ref_len"]).withColumn("_first", F.col("_first") + F.coalesce(F.sum("_n").over(by_range), F.lit(0))).where(wanted(F.col("_first"), F.col("_n")))
    place = F.col("_first") + F.row_number().over(Window.partitionBy("severity", "ref_len", "_r").orderBy("idx")) - 1
    ranked = rows.join(F.broadcast(spans.select("severity", "ref_len", "_r", "_first", "_step")), ["severity", "ref_len", "_r"]).withColumn("_k", place)  # at most n spans
    return ranked.where((F.col("_k") % F.col("_step") == 0) & (F.col("_k") / F.col("_step") < target)).select(*errors.columns)


def _range(key: str) -> Column:
    """The range of a number's order: blocks of 65,536 values, which rise with the numbers; other types have one."""
    return F.coalesce(F.shiftright(F.col(key).try_cast("long"), 16), F.lit(0))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the order of md5(seed and key); the same rows under any partitioning."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def speaker_split(samples: DataFrame, user: str = "user_id", seed: int = 42) -> DataFrame:
    """Adds split. Of all speakers, a tenth (one at least) are for validation and as many for test;
    none is in two splits. Speakers are taken in order of md5(seed and id)."""
    users = samples.select(user).where(F.col(user).isNotNull()).distinct()
    # Ranks without one task for all speakers: counts of hash ranges give each range its first rank.
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.col(user).cast("string")))
    hashed = users.withColumn("_h", code).withColumn("_r", F.substring("_h", 1, 2))
    ranges = hashed.groupBy("_r").agg(F.count("*").alias("_n"))  # 256 rows at most
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())})
    ranked = hashed.join(F.broadcast(offsets), "_r").withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy("_r").orderBy("_h", user)) - 1)
    n_val = F.greatest(F.lit(1), F.floor(F.col("_all") * 0.1))
    n_test = F.greatest(F.lit(2), F.floor(F.col("_all") * 0.2))
    split = F.when(F.col("_k") < n_val, "validation").when(F.col("_k") < n_test, "test").otherwise("train")
    return samples.join(ranked.select(user, split.alias("split")), user, "left")
