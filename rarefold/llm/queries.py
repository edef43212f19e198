"""The thin queries opN_<name> over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.llm import license_scans, lm_scoring, media, near_dup, packing, piece_codec, quality_classifier, quality_rules, secret_scans, warc
from rarefold.llm.common import load


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(load(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(load(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = quality_classifier.scored(docs.select("doc_id", "text"), quality_classifier.trained(docs, load(spark, sf_dir, "labels")))
    return out.select("doc_id", (quality_classifier.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digested(load(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scans.scanned(load(spark, sf_dir, "documents").select("doc_id", "text"))
    each = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"]))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(each, ",").alias("matches"), F.array_join(F.transform("licenses", lambda x: x["wording"]), ";").alias("wording"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.coded(load(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).drop("text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.grouped(load(spark, sf_dir, "documents"), width=2, percent=80)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scans.scanned(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_packing, op3_quality_classifier, op4_media_columns, op5_license_scans, op6_sentencepiece, op7_quality_rules, op8_minhash_near_dedup, op9_secret_scans, op10_lm_scoring)}
ORACLES = {
    "op1_warc": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (SELECT h, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY h)
        SELECT page_id, n::BIGINT AS payload_bytes, p.h AS payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to
        FROM p LEFT JOIN b ON p.h = b.h AND n >= 1000""",
    "op7_quality_rules": r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        s AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        g AS (SELECT doc_id, r.i, array_to_string(w[r.i:r.i + 7], ' ') AS g FROM s, range(1, len(w) - 6) AS r(i)),
        c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
        v AS (SELECT doc_id, count(DISTINCT i + k.k) AS n FROM c, range(0, 8) AS k(k) WHERE c > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, source, t, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM (SELECT doc_id, source, t, unnest(ls) AS x FROM s)),
        f AS (SELECT source, line, count(DISTINCT doc_id) AS c, min(doc_id) AS first FROM l GROUP BY source, line),
        x AS (SELECT l.doc_id, sum(len(string_split(l.line, ' '))) AS n FROM l JOIN f USING (source, line) WHERE c > 25 AND l.doc_id <> f.first GROUP BY l.doc_id),
        b AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n, 0)::BIGINT AS n_removed_words FROM s LEFT JOIN v USING (doc_id) LEFT JOIN x USING (doc_id)),
        k AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_removed_words >= 0.3 * n_words AS kept, n_removed_words FROM k""",
}
