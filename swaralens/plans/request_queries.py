"""Registered queries of requests, reports, readers and sinks, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import english, lexicons, text
from ..operators import reports, sampling, spelling, workflows
from ..sources import readers, segments
from . import queries as base
from .registry import DEVA, ORACLE_SQL, B, listed, load, query, rows, sql_map

# --- Requests -------------------------------------------------------------------------------------


def _word(n) -> F.Column:
    return F.element_at(lexicons.literal_array(base.WORD_OF[v] for v in range(100)), (n + 1).cast("int"))


@query("""
SELECT o_orderkey, 'कुल ' || v || ' online फल' AS normalized, 'कुल ' || v || ' [EN]online[/EN] फल' AS tagged, 'online' AS english
FROM (SELECT o_orderkey, ((o_orderkey % 9 + 1) * 100 + o_orderkey % 90 + 10)::VARCHAR AS v FROM orders)""")
def normalize_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    said = load(spark, sf_dir, "orders").select(k, F.concat(F.lit("कुल "), _word(k % 9 + 1), F.lit(" सौ "), _word(k % 90 + 10), F.lit(" online फल")).alias("text"))
    return workflows.normalize_request(said).select("o_orderkey", "normalized", "tagged", F.array_join("english_words", ",").alias("english"))


@query(f"""
WITH p AS (SELECT p_partkey, regexp_extract_all(p_name || ' पन्ना ' || p_type, '([{B}]+|[^{B}]+)') AS parts FROM part)
SELECT p_partkey, array_to_string(list_transform(parts, lambda t: CASE WHEN {base._english_sql("t")} THEN '[EN]' || t || '[/EN]' ELSE t END), '') AS tagged,
  array_to_string(list_filter(parts, lambda t: {base._english_sql("t")}), ',') AS english FROM p""")
def detect_requests(spark, sf_dir):
    said = load(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" पन्ना "), "p_type").alias("text"))
    return workflows.detect_request(said).select("p_partkey", "tagged", F.array_join("english_words", ",").alias("english"))


@query(f"WITH {base.S_WORDS} SELECT word, verdict, confidence, reason FROM results ORDER BY word LIMIT 500")
def spell_requests(spark, sf_dir):
    """A request takes its first 500 words: here those of all documents in order."""
    return workflows.spell_request(base.spell_words(spark, sf_dir), "word")[0]


@query("""
SELECT o_orderkey AS utt_id, CASE WHEN o_orderkey % 2 = 0 THEN 'कुल 2 घर' ELSE 'कुल दो घर' END AS raw_asr, 'कुल 2 घर' AS reference FROM orders WHERE o_orderkey % 3 <> 0""")
def one_model(spark, sf_dir):
    """The pairs of one model of a sheet; rows without its text are left out."""
    k = F.col("o_orderkey")
    sheet = load(spark, sf_dir, "orders").select(k.alias("utt_id"), F.lit("कुल 2 घर").alias("Human"), F.when(k % 3 != 0, F.when(k % 2 == 0, "कुल 2 घर").otherwise("कुल दो घर")).alias("Model H"), F.lit("x").alias("Model i"))
    return workflows.cleanup_pairs(sheet)


#: A letter with its dot as one character, which composition takes apart, as the number words have it.
KARORE = "करो" + chr(0x095C)


@query(f"""
SELECT o_orderkey, (o_orderkey % 9 + 1) * 10000000 || ' घर' AS composed, o_orderkey % 9 + 1 || ' {KARORE} घर' AS plain FROM orders""")
def composed_numbers(spark, sf_dir):
    """Numbers of texts that are not composed, with composition and without."""
    said = F.concat(_word(F.col("o_orderkey") % 9 + 1), F.lit(f" {KARORE} घर"))
    return load(spark, sf_dir, "orders").select("o_orderkey", english.clean_pipeline(said, compose=True)["normalized"].alias("composed"), english.clean_pipeline(said)["normalized"].alias("plain"))


# --- Tokens and titles ----------------------------------------------------------------------------


@query(f"""
WITH w AS (SELECT o_orderkey, {base.HINDI}[1 + o_orderkey % 102] || repeat('x', (o_orderkey % 12)::BIGINT) AS w FROM orders)
SELECT o_orderkey, length(regexp_replace(w, '[^{DEVA}]', '', 'g')) / length(w) > 0.3 AS devanagari FROM w""")
def devanagari_tokens(spark, sf_dir):
    words = lexicons.literal_array(w for names in lexicons.NUMBER_WORDS.values() for w in names.split())
    k = F.col("o_orderkey")
    word = F.concat(F.element_at(words, (1 + k % 102).cast("int")), F.repeat(F.lit("x"), (k % 12).cast("int")))
    return load(spark, sf_dir, "orders").select("o_orderkey", text.is_devanagari_token(word).alias("devanagari"))


@query("""
WITH i AS (SELECT DISTINCT replace(p_type, ' ', '_') || '_' || p_brand AS id FROM part)
SELECT id, array_to_string(list_transform(regexp_extract_all(replace(id, '_', ' '), '([\\p{L}]+|[^\\p{L}]+)'), lambda r: upper(r[1]) || lower(r[2:])), '') AS title FROM i""")
def category_titles(spark, sf_dir):
    ids = load(spark, sf_dir, "part").select(F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("_"), "p_brand").alias("id")).distinct()
    return ids.select("id", text.title_id("id").alias("title"))


# --- Segments -------------------------------------------------------------------------------------

#: Payloads by the key of an event: text, bounds or their lack, lists, and what gives no segment.
PAYLOADS = (
    '"  line K "', '{"text":"","sentence":"line K"}', '{"transcription":5,"text":"line K"}', '[{"transcription":"line K","start":0,"end":1.5}," b ",5,{"text":" "}]', '{"text":"line K","start":-1,"end":1}',
    '{"text":"line K","start":0,"end":31}', '{"text":"line K","start":2,"end":2}', "not json K", '{"text":"line K","start":"x","end":2}', '{"text":"line K","start":0,"end":0.5}', '{"text":"line K","start":1}', '{"text":"!?","start":0,"end":2}',
)
SEGMENT_SQL = """
e AS (SELECT event_id AS recording_id, event_id % 12 AS kind, 'line ' || event_id AS line, (event_id % 40)::DOUBLE AS audio FROM events),
found AS (
  SELECT recording_id, 0::BIGINT AS segment, CASE kind WHEN 11 THEN '' ELSE line END AS sentence,
    CASE WHEN kind IN (0, 1, 10) THEN audio WHEN kind = 3 THEN least(audio, 1.5) WHEN kind = 4 THEN least(audio, 1.0) WHEN kind = 5 THEN least(audio, 31.0) WHEN kind = 9 THEN least(audio, 0.5) WHEN kind = 11 THEN least(audio, 2.0) WHEN kind = 6 THEN least(audio, 2.0) - 2.0 ELSE 0.0 END AS duration,
    kind IN (3, 4, 5, 6, 8, 9, 11) AS bounded, kind FROM e WHERE kind NOT IN (2, 7)
  UNION ALL SELECT recording_id, 1, 'b', audio, false, 0 FROM e WHERE kind = 3),
s AS (
  SELECT recording_id, segment, sentence, duration, CASE WHEN sentence = '' THEN 'empty' WHEN length(sentence) - length(replace(sentence, ' ', '')) + 1 > 1 AND recording_id % 5 = 0 AND sentence <> 'b' THEN 'too many tokens'
    WHEN kind = 8 OR bounded AND duration <= 0 THEN 'bad bounds' WHEN duration < 0.5 OR duration > 30 THEN 'duration' END AS drop_reason FROM found)"""


def event_segments(spark, sf_dir):
    """Segments of a payload for every event, with two tokens too many in every fifth."""
    k = F.col("event_id")
    payload = F.replace(F.element_at(lexicons.literal_array(PAYLOADS), (1 + k % 12).cast("int")), F.lit("K"), k.cast("string"))
    given = load(spark, sf_dir, "events").select(k.alias("recording_id"), payload.alias("payload"), (k % 40).cast("double").alias("audio_seconds"))
    found = segments.extract_segments(given)
    return segments.build_samples(found, F.when(F.col("recording_id") % 5 == 0, F.size(text.tokens("text"))).otherwise(0), 1)


@query(f"WITH {SEGMENT_SQL} SELECT recording_id, segment, sentence, duration, drop_reason FROM s")
def transcript_segments(spark, sf_dir):
    duration = F.when(F.isnan("start") | F.isnan("end"), F.lit(0.0)).otherwise(F.col("duration"))
    return event_segments(spark, sf_dir).select("recording_id", F.col("segment").cast("long").alias("segment"), "sentence", F.coalesce(duration, "duration").alias("duration"), "drop_reason")


@query(f"WITH {SEGMENT_SQL} SELECT count_if(drop_reason IS NULL)::BIGINT AS retained, count_if(drop_reason IS NOT NULL)::BIGINT AS skipped FROM s")
def segment_retention(spark, sf_dir):
    return segments.retention(event_segments(spark, sf_dir))


# --- Readers and sinks ----------------------------------------------------------------------------


@query(ORACLE_SQL["manifest_rewrite"])
def manifest_round_trip(spark, sf_dir):
    """The manifest, written as JSON arrays and read again."""
    path = readers.scratch(spark, "manifest")
    reports.write_array(base.manifest_rewrite(spark, sf_dir), path)
    return readers.read_manifest(spark, path)


@query("""
SELECT o_orderkey AS utt_id, 'यह "' || o_orderpriority || '" है' AS raw_asr, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS reference FROM orders""")
def pairs_round_trip(spark, sf_dir):
    """Pairs with quotes and missing references, written as JSON arrays and read again."""
    path = readers.scratch(spark, "pairs")
    pairs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("utt_id"), F.concat(F.lit('यह "'), "o_orderpriority", F.lit('" है')).alias("raw_asr"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderstatus")).alias("reference"))
    reports.write_array(pairs, path)
    return readers.read_pairs(spark, path)


@query(f"WITH {base.S_WORDS} SELECT word, verdict, confidence FROM results WHERE regexp_matches(word, '^[A-Za-zऀ-ॿ]+$')")
def verdicts_round_trip(spark, sf_dir):
    """The verdicts, written as CSV and read again."""
    path = readers.scratch(spark, "verdicts")
    reports.write_csv(spelling.spell_classify(base.spell_words(spark, sf_dir)), path)
    found = readers.read_csv(spark, path, "word string, verdict string, confidence string, reason string")
    return found.where(F.col("word").rlike("^[A-Za-zऀ-ॿ]+$")).select("word", "verdict", "confidence")


@query(ORACLE_SQL["extract_urls"].replace("SELECT DISTINCT url FROM u", "SELECT DISTINCT url AS word FROM u"))
def urls_round_trip(spark, sf_dir):
    """Addresses as lines of text, read as a word list."""
    path = readers.scratch(spark, "urls")
    reports.write_lines(base.extract_urls(spark, sf_dir), "url", path)
    return readers.read_wordlist(spark, path)


@query(f"WITH {base.TOKEN_ROWS} SELECT w AS word, count(*) AS n FROM t GROUP BY w")
def corpus_round_trip(spark, sf_dir):
    """The words of a corpus of lines of text."""
    path = readers.scratch(spark, "corpus")
    lines = load(spark, sf_dir, "documents").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("line"))
    reports.write_lines(lines, "line", path)
    return readers.corpus_words(readers.read_corpus(spark, path)).groupBy("word").agg(F.count("*").alias("n"))


@query("""
SELECT page_id::VARCHAR AS sheet_id, 'https://sheets.example/d/' || page_id || '/export?format=xlsx' AS export_url FROM pages WHERE page_id % 2 = 0""")
def sheet_exports(spark, sf_dir):
    host = F.when(F.col("page_id") % 2 == 0, F.lit("sheets.example")).otherwise(F.lit("other.example"))
    urls = load(spark, sf_dir, "pages").select(F.concat(F.lit("https://"), host, F.lit("/d/"), F.col("page_id").cast("string"), F.lit("/edit")).alias("url"))
    return readers.sheet_exports(urls, "sheets.example")


# --- Reports --------------------------------------------------------------------------------------


def event_errors(spark, sf_dir):
    return base.category_errors(spark, sf_dir).withColumn("severity", sampling.severity((F.col("idx") % 1101) / 10))


def evaluated(spark, nested: bool):
    """An existing report whose evaluated fix has its rates below results, or beside its name."""
    rates = "named_struct('wer_before', 40.0D, 'wer_after', 30.0D, 'delta_pp', 10.0D)"
    flat = "'wer_before', 40.0D, 'wer_after', 30.0D, 'delta_pp', 10.0D"
    fix = f"named_struct('name', 'Number layer', 'target_subset_size', 12, {f'{chr(39)}results{chr(39)}, {rates}' if nested else flat})"
    return spark.sql(f"SELECT 'events' AS dataset, {fix} AS implemented_fix")


@query(f"""
WITH {base.CATEGORY_SQL}, t AS (SELECT count(*) AS n, string_agg(id || ':' || frequency, ' ' ORDER BY rank) AS categories, string_agg(coalesce({sql_map({k: v[1] for k, v in lexicons.CATEGORIES.items()})}[id], 'Mitigate ' || id), ', ' ORDER BY rank) FILTER (rank <= 3) AS fixes FROM r),
w AS (SELECT event_id % 1101 / 10 AS w FROM events),
l AS (SELECT string_agg(severity || '=' || n, ' ' ORDER BY severity) AS severities FROM (SELECT CASE WHEN w > 0 AND w <= 25 THEN 'Low' WHEN w > 25 AND w <= 50 THEN 'Medium' WHEN w > 50 AND w <= 75 THEN 'High' WHEN w > 75 AND w <= 101 THEN 'Severe' END AS severity, count(*) AS n FROM w GROUP BY 1) WHERE severity IS NOT NULL)
SELECT kind, CASE kind WHEN 'none' THEN 'Live Hindi ASR evaluation' ELSE 'events' END AS dataset, (SELECT count(*) FROM events) AS total, categories, fixes, severities, CASE kind WHEN 'none' THEN 'Not yet evaluated' ELSE 'Number layer' END AS fix,
  CASE kind WHEN 'none' THEN NULL ELSE 40.0 END::DOUBLE AS wer_before, CASE kind WHEN 'none' THEN NULL ELSE 10.0 END::DOUBLE AS delta_pp
FROM t CROSS JOIN l CROSS JOIN (VALUES ('none'), ('flat'), ('nested')) AS v(kind)""")
def submission_report(spark, sf_dir):
    """The whole report of one table of errors, beside no existing report, a flat one and a nested one."""
    errors = event_errors(spark, sf_dir)
    out = None
    for kind, existing in (("none", None), ("flat", evaluated(spark, False)), ("nested", evaluated(spark, True))):
        r = reports.submission_report(errors, existing)
        part = r.select(
            F.lit(kind).alias("kind"), "dataset", F.col("sampling.total_error_samples").alias("total"), F.array_join(F.transform("error_taxonomy.categories", lambda c: F.concat(c["id"], F.lit(":"), c["frequency"].cast("string"))), " ").alias("categories"),
            F.array_join(F.transform("top_fixes", lambda f: f["fix_name"]), ", ").alias("fixes"), F.array_join(F.transform(F.map_entries("sampling.severity_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias("severities"),
            F.col("implemented_fix.name").alias("fix"), F.col("implemented_fix.wer_before").alias("wer_before"), F.col("implemented_fix.delta_pp").alias("delta_pp"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT * FROM (VALUES ('error_taxonomy.categories', true), ('implemented_fix.wer_before', true), ('sampling.total_error_samples', true), ('results.none', false), ('other', false)) AS v(key, present)""")
def report_completeness(spark, sf_dir):
    """A report that is written, read again and asked for its keys."""
    path = readers.scratch(spark, "report")
    reports.write_report(reports.submission_report(event_errors(spark, sf_dir)), path)
    keys = ["error_taxonomy.categories", "implemented_fix.wer_before", "sampling.total_error_samples", "results.none", "other"]
    return reports.completeness(readers.read_report(spark, path), keys)


@query("SELECT * FROM (VALUES ('q1', true), ('q2', false)) AS v(report, present)")
def report_status(spark, sf_dir):
    path = readers.scratch(spark, "status")
    reports.write_report(reports.value_counts(load(spark, sf_dir, "events"), "event_type").agg(F.sum("n").alias("n")), path)
    return readers.report_status(spark, {"q1": path, "q2": path + "-none"})


@query(f"""
WITH w AS (SELECT doc_id, unnest({listed(["words", "recordings", "models"])}) AS kind FROM documents) SELECT kind, count(*) AS n FROM w GROUP BY kind""")
def sheet_roles(spark, sf_dir):
    """The roles of three sheets by their headers, for every document."""
    found = readers.classify_sheets({"a": ["word", "n"], "b": [*readers.SHEET_KEYS], "c": ["Human", "Model H"]})
    roles = rows(spark, [(k,) for k in sorted(found)], "kind string")
    return load(spark, sf_dir, "documents").select("doc_id").crossJoin(F.broadcast(roles)).groupBy("kind").agg(F.count("*").alias("n"))  # three rows
