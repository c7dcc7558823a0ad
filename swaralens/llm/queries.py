"""Registered queries of the training-data operators: thin contract queries over the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import mixing, ogg, pieces, pii, simhash, substrings, token_counts, topk, toxicity, url_filter
from .common import table

RULES = [
    url_filter.Rule.of("block", "com/en/"),
    url_filter.Rule.of("allow", "example.com/en/7"),
    url_filter.Rule.of("allow", "net/de/"),
    url_filter.Rule.of("block", "example.net/de/8"),
    url_filter.Rule.of("block", "org/es/"),
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark, sf_dir):
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filters(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_suffix_array_dedup(spark, sf_dir):
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_ogg(spark, sf_dir):
    return ogg.from_media(ogg.to_media(table(spark, sf_dir, "documents")))


def op8_exact_top_k(spark, sf_dir):
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op9_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark, sf_dir):
    return pieces.piece_codes(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_toxicity, op3_url_filters, op4_token_counts, op5_suffix_array_dedup, op6_pii, op7_ogg, op8_exact_top_k, op9_source_mixing, op10_sentencepiece)}

#: Each reads its table whole. op5's SQL looks at every 50-byte string of every text, as hexadecimal digits;
#: texts are cut into overlapping pieces first, so that taking a string does not walk its text. On these pages links stay within their host, so trust and
#: distrust stay where they start and a host's verdict follows from its share of the seeds.
ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": """
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
    SELECT row_number() OVER () AS no, page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM rest),
fits AS (
    SELECT p.no, r.verdict, r.host || r.path AS rule, row_number() OVER (PARTITION BY p.no ORDER BY length(r.host || r.path) DESC) AS turn
    FROM parts p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)),
judged AS (SELECT p.*, f.rule, f.verdict FROM parts p LEFT JOIN fits f ON f.no = p.no AND f.turn = 1),
links AS (SELECT host, unnest(regexp_extract_all(html, '(?i)(?:^|[^\\w-])href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS href FROM parts WHERE host <> ''),
own AS (SELECT DISTINCT host FROM links),
mass AS (
    SELECT host, count(*) FILTER (verdict = 'allow') / sum(count(*) FILTER (verdict = 'allow')) OVER () AS trust, count(*) FILTER (verdict = 'block') / sum(count(*) FILTER (verdict = 'block')) OVER () AS distrust
    FROM judged WHERE host <> '' GROUP BY host),
spread AS (SELECT m.host, m.trust * CASE WHEN o.host IS NULL THEN 1 ELSE 1 / 0.15 END AS trust, m.distrust * CASE WHEN o.host IS NULL THEN 1 ELSE 1 / 0.15 END AS distrust FROM mass m LEFT JOIN own o USING (host)),
ranks AS (SELECT host, coalesce(trust / nullif(sum(trust) OVER (), 0), 0) AS trust, coalesce(distrust / nullif(sum(distrust) OVER (), 0), 0) AS distrust FROM spread)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN r.distrust > r.trust * (1 + 1e-9) THEN 'block' END, 'allow') AS verdict
FROM judged j LEFT JOIN ranks r USING (host)
""",
    "op5_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS no, CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT no, doc_id, h, length(h) // 2 - 49 AS windows, unnest(range(0, length(h) // 2 - 49, 256)) AS c FROM d),
p AS (SELECT no, doc_id, c, least(256, windows - c) AS n, substr(h, 2 * c + 1, 610) AS part FROM c),
w AS (SELECT no, doc_id, c, part, unnest(range(0, n)) AS k FROM p),
s AS (SELECT no, doc_id, c + k AS k, substr(part, 2 * k + 1, 100) AS s FROM w),
f AS (SELECT s, min(doc_id) AS low FROM s GROUP BY s),
lost AS (SELECT no, k FROM s JOIN f USING (s) WHERE low < doc_id),
marked AS (SELECT no, k, CASE WHEN k <= lag(k) OVER (PARTITION BY no ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM lost),
numbered AS (SELECT no, k, sum(fresh) OVER (PARTITION BY no ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT no, min(k) AS a, max(k) + 50 AS b FROM numbered GROUP BY no, run),
gaps AS (SELECT no, coalesce(lag(b) OVER (PARTITION BY no ORDER BY a), 0) AS since, a, b FROM runs),
kept AS (SELECT no, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps JOIN d USING (no) GROUP BY no)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (no)
""",
    "op8_exact_top_k": """
WITH sound AS (
    SELECT row_number() OVER () AS no, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT q.no, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.terms, c.terms), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
    FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
