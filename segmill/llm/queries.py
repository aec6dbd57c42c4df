"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segmill.llm import (
    bpe_automaton,
    exact_dedup,
    fill_in_middle,
    language_id,
    minhash,
    packing,
    quality,
    simhash,
    token_counts,
    url_filter,
    vector_codes,
    warc,
    weighted_sampling,
)

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.detect(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edited_likeness(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op11_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"))


OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), f AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""

OP4 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM n
"""

OP8 = """
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a
), c AS (
  SELECT page_id,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM b
), d AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule
  FROM c
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM d
"""

def _codes(k: int) -> str:
    """CTEs of one assignment by the entries of round k, and of their means."""
    return f"""a{k} AS (
  SELECT part, vec_id, label, any_value(p.body) AS body, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d
  FROM (SELECT p.*, c.entry, list_sum(list_transform(range(1, len(p.body) + 1), lambda i: (p.body[i] - c.body[i]) * (p.body[i] - c.body[i]))) AS d
        FROM p JOIN c{k} c USING (part)) p
  GROUP BY part, vec_id, label
), m{k} AS (
  SELECT part, entry, list(m ORDER BY pos) AS body
  FROM (SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m
        FROM (SELECT part, entry, unnest(body) AS x, generate_subscripts(body, 1) AS pos FROM a{k}) GROUP BY part, entry, pos)
  GROUP BY part, entry
), c{k + 1} AS (
  SELECT part, entry, coalesce(m{k}.body, c{k}.body) AS body FROM c{k} LEFT JOIN m{k} USING (part, entry)
)"""


OP11 = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x) AS BIGINT)) AS body FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, label, CAST(k AS INTEGER) AS part, body[k * (len(body) // 16) + 1 : (k + 1) * (len(body) // 16)] AS body FROM v, range(16) r(k)
), c0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, body
  FROM p SEMI JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64) f USING (vec_id)
), {_codes(0)}, {_codes(1)}, {_codes(2)},
told AS (
  SELECT sha256(string_agg(array_to_string(body, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, told
"""

OP12 = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS d FROM documents
), c AS (
  SELECT *, CAST('0x' || d[1:8] AS BIGINT) % (n + 1) AS one, CAST('0x' || d[9:16] AS BIGINT) % (n + 1) AS two,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || d[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), f AS (
  SELECT *, substr(text, 1, least(one, two)) AS prefix, substr(text, least(one, two) + 1, greatest(one, two) - least(one, two)) AS middle, substr(text, greatest(one, two) + 1) AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(one, two) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(one, two) - least(one, two) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""

OP13 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
  FROM w
), u AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS same FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met WHERE 100 * same >= 80 * (total - same) UNION ALL SELECT b, a FROM met WHERE 100 * same >= 80 * (total - same)
), r AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, links.b FROM r JOIN links ON links.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_bpe_automaton, op3_language_id, op4_exact_dedup, op5_packing,
        op6_simhash, op7_quality, op8_url_filter, op9_weighted_sampling, op10_token_counts,
        op11_elkan_codes, op12_fill_in_middle, op13_hyperminhash,
    )
}

ORACLE: dict[str, str] = {"op1_warc": OP1, "op4_exact_dedup": OP4, "op8_url_filter": OP8, "op11_elkan_codes": OP11, "op12_fill_in_middle": OP12, "op13_hyperminhash": OP13}
