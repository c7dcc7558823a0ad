"""Operators, readers, sinks and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from swaralens.operators import lattices, reports, sampling, spelling
from swaralens.sources import readers, segments
from swaralens.streaming import transcripts


def test_no_models_give_an_empty_lattice(spark):
    from swaralens.functions.lattice import lattice_tokens, lattice_wer

    row = spark.createDataFrame([("a b",)], "h string").select(lattice_wer(F.array().cast("array<array<string>>"), lattice_tokens("h")).alias("s")).first()["s"]
    assert (row["wer"], row["insertions"], row["ref_length"]) == (0.0, 2, 0)


def test_averages_divide_by_all_utterances(spark):
    scores = spark.createDataFrame([(1, "M1", 0.0, 0.0), (1, "M2", 50.0, 50.0), (2, "M1", 0.0, 0.0), (2, "M3", 0.0, 0.0)], "utt_id long, model string, standard_wer double, lattice_wer double")
    got = {r["model"]: r["standard_wer"] for r in lattices.model_averages(scores).collect()}
    assert got["M2"] == 25.0


def test_rows_with_few_models_are_left_out(spark):
    hyps = spark.createDataFrame([(1, "a", 0, "A", "a"), (1, "a", 1, "B", "a"), (2, "a", 0, "A", "a")], "utt_id long, reference string, model_ord int, model string, hyp string")
    assert {r["utt_id"] for r in lattices.with_enough_models(hyps).collect()} == {1}


@pytest.mark.parametrize("rate, name", [(25.0, "Low"), (25.1, "Medium"), (50.0, "Medium"), (75.1, "Severe"), (101.0, "Severe"), (101.1, None), (0.0, None)])
def test_severity(spark, rate, name):
    assert spark.createDataFrame([(rate,)], "r double").select(sampling.severity(F.col("r")).alias("s")).first()["s"] == name


def test_every_nth_row_is_sampled(spark):
    rows = [(i, i, "Low") for i in range(30)] + [(100 + i, i, "High") for i in range(5)]
    got = sampling.stratified_sample(spark.createDataFrame(rows, "idx long, ref_len long, severity string")).collect()
    assert sorted(r["idx"] for r in got if r["severity"] == "Low") == list(range(0, 26, 2)) and sum(r["severity"] == "High" for r in got) == 5


@pytest.mark.parametrize("n, sizes", [(1, (0, 1, 0)), (2, (0, 1, 1)), (5, (3, 1, 1)), (10, (8, 1, 1)), (19, (16, 1, 2)), (20, (16, 2, 2))])
def test_speakers_are_in_one_split(spark, n, sizes):
    rows = spark.createDataFrame([(u, k) for u in range(n) for k in range(3)], "user_id long, k int")
    got = sampling.speaker_split(rows).select("user_id", "split").distinct().collect()
    count = lambda s: sum(r["split"] == s for r in got)
    assert len(got) == n and (count("train"), count("validation"), count("test")) == sizes


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).withColumnRenamed("id", "word")
    a = [r["word"] for r in sampling.hash_sample(rows, "word", 20).collect()]
    b = [r["word"] for r in sampling.hash_sample(rows.repartition(7), "word", 20).collect()]
    assert a == b


def test_taxonomy_order(spark):
    rows = [(k, c, "r", "h", None) for k, c in enumerate(["b", "a", "a", "b", "c", None])]
    got = reports.taxonomy(spark.createDataFrame(rows, "idx long, category string, reference string, hypothesis string, root_cause string")).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b", "c", "nan"] and [r["frequency_pct"] for r in got] == [33.33, 33.33, 16.67, 16.67]


def test_fix_evaluation_of_nothing_is_null(spark):
    row = reports.fix_evaluation(spark.createDataFrame([("क", "क")], "reference string, hypothesis string")).first()
    assert tuple(row) == (0, None, None, None)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"user_id": 1, "recording_id": 2, "duration": 1.5}]), "utf-8")
    assert readers.read_manifest(spark, str(tmp_path / "m.json")).first()["recording_id"] == 2
    (tmp_path / "p.json").write_text(json.dumps([{"raw_asr": "क"}, {"raw_asr": "ख", "reference": "ग"}], ensure_ascii=False, indent=2), "utf-8")
    assert [tuple(r) for r in readers.read_pairs(spark, str(tmp_path / "p.json")).orderBy("utt_id").collect()] == [(0, "क", ""), (1, "ख", "ग")]
    (tmp_path / "l.json").write_text(json.dumps({"reference": "a", "models": {"Z": "x", "A": "y"}}, indent=2), "utf-8")
    assert [(r["model_ord"], r["model"]) for r in readers.read_lattice_input(spark, str(tmp_path / "l.json")).orderBy("model_ord").collect()] == [(0, "Z"), (1, "A")]
    words = spark.createDataFrame([(1, "NA"), (0, "क")], "pos int, word string")
    reports.write_csv(words, str(tmp_path / "w"), "pos")
    assert [r["word"] for r in readers.read_csv(spark, str(tmp_path / "w"), "word string").collect()] == ["क", "NA"]
    reports.write_report(spark.sql("select 1 a, struct(cast(null as int) b) s"), str(tmp_path / "r"))
    report = readers.read_report(spark, str(tmp_path / "r"))
    assert [r["present"] for r in reports.completeness(report, ["a", "s.b", "x"]).collect()] == [True, True, False]
    assert readers.read_report(spark, str(tmp_path / "none")) is None
    reports.write_array(spark.range(5).selectExpr("id user_id", "id recording_id", "cast(null as string) language").repartition(3), str(tmp_path / "a"))
    assert sorted(r["recording_id"] for r in readers.read_manifest(spark, str(tmp_path / "a")).collect()) == [0, 1, 2, 3, 4]
    reports.write_array(spark.range(0).selectExpr("id user_id"), str(tmp_path / "e"))
    assert readers.read_manifest(spark, str(tmp_path / "e")).count() == 0
    reports.write_lines(words, "word", str(tmp_path / "t"))
    assert {r["word"] for r in readers.read_wordlist(spark, str(tmp_path / "t")).collect()} == {"क", "NA"}
    assert [r["present"] for r in readers.report_status(spark, {"r": str(tmp_path / "r"), "n": str(tmp_path / "n")}).collect()] == [True, False]


def test_sheets(spark):
    keys = list(readers.SHEET_KEYS)
    found = readers.classify_sheets({"a": ["word"], "b": keys, "c": ["Human", "Model H"], "d": [" word ", None]})
    assert found == {"words": "d", "recordings": "b", "models": "c"}
    with pytest.raises(ValueError):
        readers.classify_sheets({"a": ["word"]})
    urls = spark.createDataFrame([("https://sheets.example/d/abc/edit",), ("https://other/d/x/",)], "url string")
    assert [r["sheet_id"] for r in readers.sheet_exports(urls, "sheets.example").collect()] == ["abc"]


def test_manifest_needs_a_folder(spark):
    rows = [(1, 9, None, None, "https://h/b/77/9_rec.wav"), (1, 9, "hi", 2.0, "https://h/9.wav"), (1, None, "hi", 2.0, "https://h/b/77/9.wav")]
    got = readers.rewrite_manifest(spark.createDataFrame(rows, "user_id long, recording_id long, language string, duration double, rec_url_gcp string"), "https://s/x/").collect()
    assert [(r["rec_url_gcp"], r["language"], r["duration"]) for r in got] == [("https://s/x/77/9_audio.wav", "hi", 0.0)]


def test_retention(spark):
    rows = spark.createDataFrame([(1, '{"text":"a","start":0,"end":2}', 9.0), (2, '{"text":"b","start":0,"end":0.1}', 9.0)], "recording_id long, payload string, audio_seconds double")
    assert tuple(segments.retention(segments.build_samples(segments.extract_segments(rows))).first()) == (1, 1)
    long = segments.build_samples(segments.extract_segments(rows), F.lit(500))
    assert {r["drop_reason"] for r in long.collect()} == {"too many tokens"}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("मुझे दो सौ रुपये",), ("मेरा interview",)], "text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = transcripts.clean_stream(transcripts.read_stream(spark, str(tmp_path / "in"), rows.schema, 1))
    got = {r["text"]: r["tagged"] for r in transcripts.run_once(stream, "cleaned").collect()}
    assert got == {"मुझे दो सौ रुपये": "मुझे 200 रुपये", "मेरा interview": "मेरा [EN]interview[/EN]"}


def test_first_rows_and_first_seen(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "w string, pos int")
    assert {tuple(r) for r in spelling.first_seen(rows, "w", "pos").collect()} == {("a", 1), ("b", 2)}
    assert {tuple(r) for r in spelling.first_rows(rows, ["w"], ["pos"], 1).collect()} == {("a", 1), ("b", 2)}


def test_requests(spark):
    from swaralens.operators import workflows

    row = workflows.normalize_request(spark.createDataFrame([("दो सौ interview",)], "text string")).first()
    assert row["normalized"] == "200 interview" and row["english_words"] == ["interview"]
    assert workflows.detect_request(spark.createDataFrame([("a क",)], "text string")).first()["tagged"] == "[EN]a[/EN] क"
    with pytest.raises(Exception, match="text is required"):
        workflows.detect_request(spark.createDataFrame([(" ",)], "text string")).collect()
    results, counts = workflows.spell_request(spark.createDataFrame([(k, "भारत") for k in range(600)], "pos int, word string"), "pos")
    assert results.count() == counts.first()["total"] == 500


def test_sheet_workflows(spark):
    from swaralens.operators import workflows

    sheet = spark.createDataFrame([(1, "200 लोग", "दो सौ लोग", "x"), (2, " ", "a", "b")], "utt_id long, Human string, `Model H` string, `Model i` string")
    rates, examples = workflows.cleanup_report(workflows.cleanup_pairs(sheet))
    assert tuple(rates.first())[0] == 1 and rates.first()["wer_after"] == 0.0 and examples.count() == 1
    pairs = spark.createDataFrame([(1, "a b c d", "a b c x"), (2, "a", "a ")], "idx long, reference string, predicted string")
    sampled, severities, fix = workflows.error_report(pairs)
    assert sampled.count() == 1 and severities.first()["severity"] == "Low" and fix.first()["n"] == 2


def test_vote_lattice(spark):
    hyps = spark.createDataFrame([(1, "a b", k, f"M{k}", h) for k, h in enumerate(["a x", "a x", "a x", "a y", "a b"])], "utt_id long, reference string, model_ord int, model string, hyp string")
    forms = lambda mode: [r["variants"] for r in lattices.bins(lattices.alignments(hyps), mode).orderBy("position").collect()]
    assert forms("vote") == [["a"], ["b", "x"]] and forms("column") == [["a"], ["b", "x", "y"]]
    rates = {r["model"]: r["lattice_wer"] for r in lattices.evaluate(hyps, "vote").collect()}
    assert rates["M0"] == 0.0 and rates["M3"] == 50.0
    with pytest.raises(ValueError):
        lattices.bins(hyps, "none")


def test_sampled_places_are_those_of_the_whole_order(spark):
    """Against every row in order; ids in several blocks, lengths with many rows, ties."""
    import math
    import random

    rng = random.Random(7)
    rows = [(k * 9973, rng.choice([1, 2, 2, 2, 5]), rng.choice(["Low", "Low", "High", None])) for k in range(400)]
    for n in (8, 50, 400):
        target, want = math.ceil(n / 4), set()
        for name in ("Low", "High"):
            own = sorted((length, i) for i, length, s in rows if s == name)
            step = max(1, len(own) // target)
            want |= {i for k, (_, i) in enumerate(own) if k % step == 0 and k / step < target}
        got = sampling.stratified_sample(spark.createDataFrame(rows, "idx long, ref_len int, severity string"), n)
        assert got.columns == ["idx", "ref_len", "severity"] and sorted(r["idx"] for r in got.collect()) == sorted(want)


def test_streams_in_several_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"w{k}",)], "word string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = transcripts.read_stream(spark, str(tmp_path / "in"), "word string", 1)
    got = transcripts.run_once(transcripts.spell_stream(stream), "spelled")
    assert sorted(r["word"] for r in got.collect()) == ["w0", "w1", "w2"] and got.columns == ["word", "verdict", "confidence", "reason"]


def test_no_local_folder_on_a_cluster(tmp_path):
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: other), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match="checkpoint"):
        readers.scratch(cluster, "x")
