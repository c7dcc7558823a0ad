"""Work that was done several times, row by row or in one task: what is left of it, and that results stay."""

import random

import pytest
from pyspark.sql import functions as F

from swaralens.functions import lattice, lexicons
from swaralens.operators import lattices
from swaralens.plans.registry import QUERIES
from test_functions import naive_path


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def python_steps(frame):
    return sum(plan(frame).count(step) for step in ("MapInArrow", "ArrowEvalPython", "MapInPandas"))


@pytest.fixture(scope="module")
def hyps(spark):
    """Small utterances with ties, gaps, capitals, number words, nulls and an utterance without an id."""
    rng, rows = random.Random(7), []
    words = ["a", "A", "b", "c", "5", "पाँच", "पांच", "फ़ोन", "१४", "चौदह", "उसने"]
    for u in [*range(60), None]:
        reference = None if u == 3 else " ".join(rng.choices(words, k=rng.randint(0, 7)))
        for k in range(rng.randint(1, 4)):
            hyp = None if rng.random() < 0.05 else " ".join(w for t in (reference or "a b").split() for w in rng.choice([[t], [t], [], [rng.choice(words)], [t, rng.choice(words)]]))
            rows.append((u, reference, k, f"M{k}", hyp))
    return spark.createDataFrame(rows, "utt_id long, reference string, model_ord int, model string, hyp string").localCheckpoint()


def same(left, right):
    key = lambda rows: sorted(map(repr, rows.collect()))
    assert left.columns == right.columns and key(left) == key(right)


def test_paths_at_sight_are_those_of_the_whole_table():
    rng = random.Random(8)
    for _ in range(3000):
        letters = "abcdef"[: rng.randint(1, 6)]
        x = rng.choices(letters, k=rng.randint(0, 8))
        y = [w for t in x for w in rng.choice([[t], [t], [], [t, "q"], ["q"], [rng.choice(letters)]])]
        for a, b in ((x, y), (y, x)):
            want = naive_path(len(a), len(b), lambda i, j: a[i] == b[j])
            assert lattice.align_words(a, b) == want
            assert lattice.distance(a, b) == sum(i < 0 or j < 0 or a[i] != b[j] for i, j in want)


def test_spellings_are_the_variants(spark):
    words = sorted({*lexicons.LATTICE_DIGITS, *lexicons.LATTICE_DIGITS.values(), *lexicons.SYNONYMS, "फ़ोन", "मैं", "हँसी", "१४", "5", "Abc", "É", "ab_12", "x"})
    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", lattice.variants("w").alias("v"))
    assert {r["w"]: frozenset(r["v"]) for r in frame.collect()} == {w: lattice.spellings(w) for w in words}


@pytest.mark.parametrize("mode", lattices.MODES)
def test_lattices_by_utterance_are_those_of_alignment_columns(hyps, mode):
    """F1, F2, F4, F7, F9: bins, votes, scores and reports against the table of alignment columns."""
    aligned = lattices.alignments(hyps)
    long = lattices.bins(aligned, mode).select("utt_id", "position", "ref", "variants")
    same(lattices.utterance_bins(hyps, mode), long)
    same(lattices.utterance_votes(hyps), lattices.votes(aligned))
    # Scores by the column functions: a lattice is an array of bins, and rows without an id have none.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "variants"))), lambda b: b["variants"])
    from swaralens.functions.metrics import standard_wer

    joined = hyps.join(long.groupBy("utt_id").agg(ordered.alias("lattice")), "utt_id", "left")
    want = joined.select("utt_id", "model", standard_wer("reference", "hyp").alias("standard_wer"), lattice.lattice_wer("lattice", lattice.lattice_tokens("hyp")).alias("s"))
    want = want.select("utt_id", "model", "standard_wer", F.col("s.wer").alias("lattice_wer"), "s.substitutions", "s.deletions", "s.insertions", F.col("s.ref_length").alias("bins"), "s.hyp_length")
    scores = lattices.evaluate(hyps, mode)
    same(scores.select(want.columns), want)
    report = lattices.lattice_report(hyps, mode)
    fields = ("model", "standard_wer", "lattice_wer", "substitutions", "deletions", "insertions", "hyp_length", "improved", "verdict")
    models = report.select("utt_id", F.explode("models").alias("m")).select("utt_id", *(f"m.{f}" for f in fields))
    same(models, scores.where("utt_id is not null").select("utt_id", *fields))
    bins = report.select("utt_id", F.explode("lattice").alias("b")).select("utt_id", "b.position", "b.variants", "b.size")
    same(bins, long.where("utt_id is not null").select("utt_id", "position", "variants", F.size("variants").alias("size")))
    assert report.count() == hyps.select("utt_id").distinct().count()


@pytest.mark.parametrize("least", [1, 2])
def test_averages_are_those_of_the_scores(hyps, least):
    """one reading of the hypotheses."""
    enough = hyps if least == 1 else lattices.with_enough_models(hyps, least)
    whole = enough.where("reference is not null and hyp is not null")
    same(lattices.averages(whole, least=1), lattices.model_averages(lattices.evaluate(whole)))
    given = hyps.where("reference is not null and hyp is not null")
    same(lattices.averages(given, least=least), lattices.model_averages(lattices.evaluate(given if least == 1 else lattices.with_enough_models(given, least))))


@pytest.mark.parametrize("name", ["lattice_report", "lattice_wer", "lattice_model_averages", "lattice_votes", "lattice_sheet", "lattice_bins", "lattice_turns", "lattice_wer_by_vote"])
def test_hypotheses_enter_python_once(spark, small, name):
    assert python_steps(QUERIES[name](spark, small)) == 1


@pytest.mark.parametrize("name", ["align_turns", "lattice_turns"])
def test_turns_of_one_file_are_dealt(spark, small, name):
    """F6, F8."""
    assert "RepartitionByExpression [conv_id" in plan(QUERIES[name](spark, small))


def test_texts_are_aligned_as_their_tokens(spark, hyps):
    """F6."""
    pairs = hyps.select(lattice.align_texts("reference", "hyp").alias("a"), lattice.align(lattice.lattice_tokens("reference"), lattice.lattice_tokens("hyp")).alias("b"))
    assert pairs.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    assert pairs.where("a is null").count() == hyps.where("reference is null or hyp is null").count() > 0


def test_cleanup_rows_are_worked_out_once(spark, small):
    """F10."""
    assert python_steps(QUERIES["cleanup_examples"](spark, small)) == 1


def test_word_edits_look_no_token_up_among_all(spark, small):
    """F11."""
    assert "array_position" not in plan(QUERIES["error_severities"](spark, small))


def test_payloads_are_parsed_once(spark, small):
    """F12."""
    assert plan(QUERIES["transcript_segments"](spark, small)).count("parseJson") + plan(QUERIES["transcript_segments"](spark, small)).count("parse_json") == 1
