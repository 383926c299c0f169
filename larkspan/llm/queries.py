"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import exact, jaccard, langid, mixing, packing, quality, sharding, substring, suffix, urlfilter

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op7_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_substring_index": op7_substring_index,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

SQL = {
    "op5_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op6_url_filter": """
        WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM a),
        m AS (SELECT *, host = 'com' OR suffix(host, '.com') AS com, host = 'net' OR suffix(host, '.net') AS net,
                     host = 'example.com' OR suffix(host, '.example.com') AS ex,
                     host = 'www.example.com' OR suffix(host, '.www.example.com') AS www FROM p)
        SELECT page_id, host, path,
               CASE WHEN www AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN ex AND starts_with(path, '/en/') THEN 'example.com/en/'
                    WHEN com AND starts_with(path, '/') THEN 'com/' WHEN net AND starts_with(path, '/es/') THEN 'net/es/'
                    WHEN net AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule,
               CASE WHEN www AND starts_with(path, '/en/') THEN 'allow' WHEN ex AND starts_with(path, '/en/') THEN 'block'
                    WHEN net AND (starts_with(path, '/es/') OR starts_with(path, '/fr/')) THEN 'block' ELSE 'allow' END AS verdict
        FROM m""",
    "op10_quality_rules": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM t),
        x AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM x),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
        cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM
                (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY 1),
        m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                     list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
                     coalesce(cov.n, 0) AS n_repeat_words,
                     len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{s}'" for s in dict.fromkeys(quality.STOP_WORDS))}], lower(x)))) AS stops
              FROM w LEFT JOIN cov USING (doc_id)),
        n AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND n_words >= 20 AND word_chars / n_words BETWEEN 2.0 AND 20.0 AND n_symbols / greatest(word_chars, 1) <= 0.1
               AND stops / n_words >= 0.02 AND n_dup_lines / greatest(len(ls), 1) <= 0.3 AND n_repeat_words / n_words <= 0.3 AS kept
        FROM n""",
}
