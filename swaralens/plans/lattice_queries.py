"""Registered queries of alignments and word lattices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lattice import align, align_texts, lattice_tokens, variants
from ..operators import lattices, workflows
from .registry import B, load, query, rows, tokens_sql, values

VARIANTS = [
    ("चौदह", ["14", "चौदह"]), ("5", ["5", "पांच", "पाँच"]), ("पाँच", ["5", "पांच", "पाँच"]), ("१४", ["14", "१४"]), ("फ़ोन", ["फोन", "फ़ोन"]), ("उसने", ["उन्होंने", "उसने"]),
    ("उन्होंने", ["उन्होंने", "उन्होँने"]), ("किताबें", ["किताबें", "किताबेँ", "पुस्तकें"]),
]


@query(f"SELECT word, array_to_string(list_sort(forms), '|') AS forms FROM {values(VARIANTS, 'word, forms')}")
def spelling_variants(spark, sf_dir):
    return rows(spark, [(w,) for w, _ in VARIANTS], "word string").select("word", F.array_join(variants("word"), "|").alias("forms"))


ALIGNED = [
    ("a b c", "a c", "a/a b/- c/c"), ("a b", "x a b", "-/x a/a b/b"), ("a b", "b a", "a/b b/a"), ("a b", "b", "a/- b/b"), ("", "x", "-/x"), ("A b", "a B", "A/a b/B"),
]


@query(f"SELECT reference, hypothesis, path FROM {values(ALIGNED, 'reference, hypothesis, path')}")
def align_pairs(spark, sf_dir):
    given = rows(spark, [x[:2] for x in ALIGNED], "reference string, hypothesis string").withColumn("p", align(lattice_tokens("reference"), lattice_tokens("hypothesis")))
    gap = lambda c: F.coalesce(c, F.lit("-"))
    return given.select("reference", "hypothesis", F.array_join(F.transform("p", lambda x: F.concat(gap(x["ref"]), F.lit("/"), gap(x["hyp"]))), " ").alias("path"))


# --- Four models over every turn ------------------------------------------------------------------


def dealt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns, dealt over the tasks: their files may be few."""
    return load(spark, sf_dir, "conversations").repartition(lattices.shares(spark), "conv_id", "turn")


def placed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, w): the words of every turn, made distinct by their places, so that each has one best
    alignment."""
    words = F.transform(text.tokens("text"), lambda t, i: F.concat(t, F.lit("_"), (i + 1).cast("string")))
    return dealt_turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt_id"), words.alias("w")).where(F.size("w") > 0)


def customer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, w): five to twelve words for every customer."""
    words = F.transform(F.sequence(F.lit(1).cast("long"), F.col("c_custkey") % 8 + 5), lambda i: F.concat(F.lit("w"), (F.col("c_custkey") % 7).cast("string"), F.lit("_"), i.cast("string")))
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("utt_id"), words.alias("w"))


def gap_hypotheses(utterances: DataFrame) -> DataFrame:
    """Four models' outputs for every utterance: words dropped, replaced, added, and dropped and added."""
    none = F.array().cast("array<string>")
    every = lambda of: F.flatten(F.transform("w", of))
    models = {
        "cut": every(lambda t, i: F.when((i + 1) % 5 == 0, none).otherwise(F.array(t))),
        "swap": every(lambda t, i: F.array(F.when((i + 1) % 4 == 0, F.lit("zz")).otherwise(t))),
        "add": every(lambda t, i: F.when((i + 1) % 6 == 0, F.array(t, F.lit("yy"))).otherwise(F.array(t))),
        "mix": every(lambda t, i: F.when((i + 1) % 7 == 0, none).when((i + 1) % 7 == 3, F.array(t, F.lit("yy"))).otherwise(F.array(t))),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("model_ord"), F.lit(m).alias("model"), F.array_join(h, " ").alias("hyp")) for k, (m, h) in enumerate(models.items()))))
    return utterances.select("utt_id", F.array_join("w", " ").alias("reference"), each.alias("m")).select("utt_id", "reference", "m.*")


TURN_SQL = f"""
w AS (SELECT conv_id * 1000 + turn AS utt_id, list_transform({tokens_sql("lower(nfc_normalize(text))")}, lambda t, i: t || '_' || i) AS r FROM conversations),"""
CUSTOMER_SQL = """
w AS (SELECT c_custkey AS utt_id, list_transform(range(1, c_custkey % 8 + 6), lambda i: 'w' || c_custkey % 7 || '_' || i) AS r FROM customer),"""
GAP_COLUMNS = """
columns AS (
  SELECT utt_id, 0 AS ord, 'cut' AS model, r, len(r) // 5 AS e, list_transform(r, lambda t, i: {'ref': t, 'hyp': CASE WHEN i % 5 <> 0 THEN t END}) AS c FROM w WHERE len(r) > 0
  UNION ALL SELECT utt_id, 1, 'swap', r, len(r) // 4, list_transform(r, lambda t, i: {'ref': t, 'hyp': CASE WHEN i % 4 = 0 THEN 'zz' ELSE t END}) FROM w WHERE len(r) > 0
  UNION ALL SELECT utt_id, 2, 'add', r, len(r) // 6, flatten(list_transform(r, lambda t, i: CASE WHEN i % 6 = 0 THEN [{'ref': t, 'hyp': t}, {'ref': NULL, 'hyp': 'yy'}] ELSE [{'ref': t, 'hyp': t}] END)) FROM w WHERE len(r) > 0
  UNION ALL SELECT utt_id, 3, 'mix', r, len(r) // 7 + (len(r) + 4) // 7,
    flatten(list_transform(r, lambda t, i: CASE i % 7 WHEN 0 THEN [{'ref': t, 'hyp': NULL}] WHEN 3 THEN [{'ref': t, 'hyp': t}, {'ref': NULL, 'hyp': 'yy'}] ELSE [{'ref': t, 'hyp': t}] END)) FROM w WHERE len(r) > 0),
flat AS (SELECT utt_id, ord, unnest(c) AS c, unnest(range(0, len(c))) AS pos FROM columns),
cells AS (SELECT utt_id, ord, pos, c.ref AS ref, c.hyp AS hyp FROM flat),
bins AS (SELECT utt_id, pos, arg_min(ref, ord) FILTER (ref IS NOT NULL) AS ref, list_sort(list_distinct(list_concat(coalesce(list(hyp) FILTER (hyp IS NOT NULL), []), [arg_min(ref, ord) FILTER (ref IS NOT NULL)]))) AS forms FROM cells GROUP BY utt_id, pos)"""
GAP_SQL = TURN_SQL + GAP_COLUMNS
#: Every model's words are in their own bins, in order: what a hypothesis lacks of the bins is deleted,
#: and nothing else costs.
GAP_SCORES = GAP_SQL + """,
many AS (SELECT utt_id, count(*) AS bins FROM bins GROUP BY utt_id),
scores AS (
  SELECT utt_id, ord, model, round_even(e / len(r) * 100, 2) AS standard_wer, round_even((bins - m) / bins * 100, 2) AS lattice_wer, 0::BIGINT AS substitutions, (bins - m)::BIGINT AS deletions, 0::BIGINT AS insertions, bins
  FROM (SELECT *, len(list_filter(c, lambda x: x.hyp IS NOT NULL)) AS m FROM columns) JOIN many USING (utt_id))"""

#: The usual table for bins that only hold what most models agree on: a number a cell, of its cost,
#: substitutions, deletions and insertions.
COST, SUBSTITUTED, DELETED = 10**12, 10**8, 10**4
VOTE_SCORES = CUSTOMER_SQL + GAP_COLUMNS + f""",
f AS (SELECT utt_id, pos, hyp AS form, count(*) AS n FROM cells WHERE hyp IS NOT NULL GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY utt_id, pos) AS share FROM f),
agreed AS (SELECT utt_id, pos, form FROM s WHERE share >= 0.6 UNION SELECT utt_id, pos, ref FROM bins WHERE ref IS NOT NULL),
voted AS (SELECT utt_id, pos, list(form) AS forms FROM agreed GROUP BY utt_id, pos),
lattice AS (SELECT utt_id, list(forms ORDER BY pos) AS lattice FROM voted GROUP BY utt_id),
h AS (SELECT utt_id, ord, model, e, len(r) AS n, list_filter(list_transform(c, lambda x: x.hyp), lambda x: x IS NOT NULL) AS h FROM columns),
u AS (SELECT h.*, len(lattice) AS bins, list_transform(lattice, lambda b: list_transform(h, lambda t: CASE WHEN list_contains(b, t) THEN 0 ELSE 1 END::BIGINT)) AS u FROM h JOIN lattice USING (utt_id)),
v AS (SELECT *, list_reduce(u, lambda acc, x:
  list_reduce(list_transform(range(1, len(h) + 1), lambda k: [k]),
    lambda line, k: list_append(line, CASE
      WHEN acc[k[1]] // {COST} + x[k[1]] <= least(acc[k[1] + 1], line[k[1]]) // {COST} + 1 THEN acc[k[1]] + x[k[1]] * {COST + SUBSTITUTED}
      WHEN acc[k[1] + 1] // {COST} <= line[k[1]] // {COST} THEN acc[k[1] + 1] + {COST + DELETED} ELSE line[k[1]] + {COST + 1} END), [acc[1] + {COST + DELETED}]),
  list_transform(range(0, len(h) + 1), lambda j: (j * {COST + 1})::BIGINT))[-1] AS v FROM u),
scores AS (
  SELECT utt_id, ord, model, round_even(e / n * 100, 2) AS standard_wer, round_even(v // {COST} / bins * 100, 2) AS lattice_wer, v // {SUBSTITUTED} % 10000 AS substitutions, v // {DELETED} % 10000 AS deletions, v % 10000 AS insertions, bins
  FROM v)"""


@query(f"""
WITH {GAP_SCORES} SELECT utt_id, model, standard_wer, lattice_wer, substitutions, deletions, insertions, bins::BIGINT AS bins, lattice_wer < standard_wer AS improved,
  CASE WHEN lattice_wer < standard_wer THEN '✓ fairer' WHEN lattice_wer = standard_wer THEN '=' ELSE '✗' END AS verdict FROM scores""")
def lattice_wer(spark, sf_dir):
    counts = (F.col(c).cast("long").alias(c) for c in ("substitutions", "deletions", "insertions", "bins"))
    return lattices.evaluate(gap_hypotheses(placed_turns(spark, sf_dir))).select("utt_id", "model", "standard_wer", "lattice_wer", *counts, "improved", "verdict")


@query(f"""
WITH {VOTE_SCORES} SELECT utt_id, model, standard_wer, lattice_wer, substitutions, deletions, insertions, bins::BIGINT AS bins FROM scores""")
def lattice_wer_by_vote(spark, sf_dir):
    """Bins hold the reference word and what three fifths of the models agree on."""
    counts = (F.col(c).cast("long").alias(c) for c in ("substitutions", "deletions", "insertions", "bins"))
    return lattices.evaluate(gap_hypotheses(customer_words(spark, sf_dir)), "vote").select("utt_id", "model", "standard_wer", "lattice_wer", *counts)


@query(f"""
WITH {GAP_SCORES}, n AS (SELECT count(DISTINCT utt_id) AS utterances FROM scores),
a AS (SELECT model, count(*) AS n, round_even(sum((standard_wer * 100)::BIGINT) / 100 / any_value(utterances), 2) AS standard_wer, round_even(sum((lattice_wer * 100)::BIGINT) / 100 / any_value(utterances), 2) AS lattice_wer FROM scores CROSS JOIN n GROUP BY model)
SELECT *, lattice_wer < standard_wer AS improved FROM a""")
def lattice_model_averages(spark, sf_dir):
    return lattices.averages(gap_hypotheses(placed_turns(spark, sf_dir))).select("model", "n", "standard_wer", "lattice_wer", "improved")


@query(f"WITH {GAP_SQL} SELECT utt_id, pos::BIGINT AS position, array_to_string(list_filter(forms, lambda x: x IS NOT NULL), '|') AS forms FROM bins")
def lattice_bins(spark, sf_dir):
    found = lattices.utterance_bins(gap_hypotheses(placed_turns(spark, sf_dir)))
    return found.select("utt_id", F.col("position").cast("long").alias("position"), F.array_join("variants", "|").alias("forms"))


@query(f"""
WITH {GAP_SQL}, f AS (SELECT utt_id, pos, hyp AS form, count(*) AS n FROM cells WHERE hyp IS NOT NULL GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY utt_id, pos) AS share FROM f)
SELECT utt_id, pos::BIGINT AS pos, form, n, share, share >= 0.6 AND form IS DISTINCT FROM ref AS trusted FROM s JOIN bins USING (utt_id, pos)""")
def lattice_votes(spark, sf_dir):
    found = lattices.utterance_votes(gap_hypotheses(placed_turns(spark, sf_dir)))
    return found.select("utt_id", F.col("pos").cast("long").alias("pos"), "form", "n", "share", "trusted")


@query(f"""
WITH {GAP_SQL} SELECT utt_id, model, md5(array_to_string(list_transform(c, lambda x: coalesce(x.ref, '-') || '/' || coalesce(x.hyp, '-')), ' ')) AS path_md5, len(c)::BIGINT AS columns FROM columns""")
def align_turns(spark, sf_dir):
    given = gap_hypotheses(placed_turns(spark, sf_dir)).select("utt_id", "model", align_texts(F.lower("reference"), F.lower("hyp")).alias("p"))
    gap = lambda c: F.coalesce(c, F.lit("-"))
    return given.select("utt_id", "model", F.md5(F.array_join(F.transform("p", lambda x: F.concat(gap(x["ref"]), F.lit("/"), gap(x["hyp"]))), " ")).alias("path_md5"), F.size("p").cast("long").alias("columns"))


@query(f"""
WITH {GAP_SCORES}, m AS (SELECT utt_id, any_value(bins)::BIGINT AS bins, string_agg(model || ':' || substitutions || '/' || deletions || '/' || insertions, ' ' ORDER BY ord) AS scores FROM scores GROUP BY utt_id),
d AS (SELECT utt_id, md5(string_agg(pos || '=' || array_to_string(list_filter(forms, lambda x: x IS NOT NULL), '|'), ' ' ORDER BY pos)) AS dump_md5 FROM bins GROUP BY utt_id)
SELECT m.utt_id, 0.6::DOUBLE AS threshold, bins, scores, dump_md5 FROM m JOIN d USING (utt_id)""")
def lattice_report(spark, sf_dir):
    """Every utterance's lattice and its models' scores, as one row."""
    found = lattices.lattice_report(gap_hypotheses(placed_turns(spark, sf_dir)))
    scores = F.transform("models", lambda m: F.concat(m["model"], F.lit(":"), F.concat_ws("/", *(m[c].cast("string") for c in ("substitutions", "deletions", "insertions")))))
    dump = F.transform("lattice", lambda b: F.concat(b["position"].cast("string"), F.lit("="), F.array_join(b["variants"], "|")))
    return found.select("utt_id", F.col("threshold").cast("double").alias("threshold"), F.col("bins").cast("long").alias("bins"), F.array_join(scores, " ").alias("scores"), F.md5(F.array_join(dump, " ")).alias("dump_md5"))


# --- Turns and sheets -----------------------------------------------------------------------------


@query(f"""
WITH w AS (SELECT conv_id * 1000 + turn AS utt_id, {tokens_sql("lower(nfc_normalize(text))")} AS r FROM conversations),
m AS (SELECT utt_id, k, r FROM w CROSS JOIN (VALUES (3), (4)) AS v(k))
SELECT utt_id, 'every ' || k AS model, round_even((len(r) // k) / len(r) * 100, 2) AS standard_wer, 0.0 AS lattice_wer, len(r)::BIGINT AS bins FROM m WHERE len(r) > 0""")
def lattice_turns(spark, sf_dir):
    """Two models that only replace words: alignments have no gaps, so every word is in its bin."""
    turns = dealt_turns(spark, sf_dir).withColumn("w", text.tokens("text")).where(F.size("w") > 0)
    swap = lambda k: F.array_join(F.transform("w", lambda t, i: F.when((i + 1) % k == 0, F.lit(f"zz{k}")).otherwise(t)), " ")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("model_ord"), F.lit(f"every {k}").alias("model"), swap(k).alias("hyp")) for k in (3, 4))))
    hyps = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt_id"), F.col("text").alias("reference"), each.alias("m")).select("utt_id", "reference", "m.*")
    return lattices.evaluate(hyps).select("utt_id", "model", "standard_wer", "lattice_wer", F.col("bins").cast("long").alias("bins"))


@query(f"""
SELECT o_orderkey AS utt_id, m AS model, h AS hyp FROM (SELECT o_orderkey, unnest([{{'m': 'Model H', 'h': o_orderpriority}}, {{'m': 'Model i', 'h': CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END}}], recursive := true) FROM orders)
WHERE regexp_matches(coalesce(h, ''), '[^{B}]')""")
def unpivot_models(spark, sf_dir):
    sheet = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("utt_id"), F.lit("x").alias("Human"), F.col("o_orderpriority").alias("Model H"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("Model i"))
    return lattices.from_wide(sheet).select("utt_id", "model", "hyp")


@query("""
WITH h AS (SELECT o_orderkey AS utt_id, o_orderkey % 4 AS k FROM orders WHERE o_orderkey % 3 <> 0)
SELECT model, n::BIGINT AS n, standard_wer, 0.0 AS lattice_wer, standard_wer > 0.0 AS improved FROM (
  SELECT 'Model H' AS model, count(*) AS n, round_even(count_if(k = 0) * 25.0 / count(*), 2) AS standard_wer FROM h
  UNION ALL SELECT 'Model i', count(*), round_even(count_if(k = 1) * 50.0 / count(*), 2) FROM h)""")
def lattice_sheet(spark, sf_dir):
    """Every third utterance lacks a model and is left out; replaced words are in their own bins."""
    k = F.col("o_orderkey") % 4
    sheet = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("utt_id"), F.lit("w x y z").alias("Human"), F.when(k == 0, "w q y z").otherwise("w x y z").alias("Model H"),
        F.when(F.col("o_orderkey") % 3 == 0, " ").when(k == 1, "w x p r").otherwise("w x y z").alias("Model i"),
    )
    return workflows.lattice_sheet(sheet).select("model", "n", "standard_wer", "lattice_wer", "improved")
