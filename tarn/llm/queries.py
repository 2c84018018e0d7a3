"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import clustering, conversations, ngram_join
from tarn.llm._common import read

SHARDS = 40


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.sharding import histogram_shards

    placed = histogram_shards(read(spark, sf_dir, "documents"), SHARDS, ["doc_id"], scanned=True)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.exact_dedup import decide

    found = decide(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.mixing import decide

    return decide(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tarn.llm import bpe

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.near_dedup import decide

    return decide(read(spark, sf_dir, "documents"), scanned=True).select("doc_id", "n_shingles", "component_id", "kept")


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.importance import resample

    found = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_ngrams", "log_weight", "gumbel_key", "kept")


def op7_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.html_main import main_text

    found = main_text(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import secrets

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(secrets.spelled(base).cast("binary"), 256).alias("base_sha256"),
        secrets.spelled(F.col("secrets")).alias("spans"),
    )


def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import language

    docs = read(spark, sf_dir, "documents")
    tagged = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return tagged.select("doc_id", F.coalesce(language.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.quality import COUNTS, judge

    found = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "mean_ratio")


def base_of_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the shards: sizes, and that slots are gapless in every shard."""
    placed = op1_histogram_shards(spark, sf_dir).select("doc_id", "size", "shard", "slot")
    told = placed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    good = told.select("shard", ((F.col("slots") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("gapless"))
    return placed.join(F.broadcast(good), "shard").select("doc_id", "size", "gapless")  # a row for each shard


def base_of_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the exact patterns."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_of_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the base rules rest on, and their verdict."""
    from tarn.llm.quality import COUNTS

    return op10_quality_rules(spark, sf_dir).select("doc_id", *COUNTS, "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_near_dedup": op5_near_dedup,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_wrapper_main_text": op7_wrapper_main_text,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_spans": op9_language_spans,
    "op10_quality_rules": op10_quality_rules,
    "base_of_op1": base_of_op1,
    "base_of_op8": base_of_op8,
    "base_of_op10": base_of_op10,
    "op11_kdtree_clusters": clustering.op11_kdtree_clusters,
    "op12_count_rtree_join": ngram_join.op12_count_rtree_join,
    "op13_trie_repair": conversations.op13_trie_repair,
}

ORACLE_SQL: dict[str, str] = {
    "base_of_op1": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size, true AS gapless FROM documents",
    "base_of_op8": r"""
SELECT doc_id,
       len([x FOR x IN regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) IF length(x) >= 12]) AS n_assign,
       len([x FOR x IN regexp_extract_all(t, 'AKIA[A-Z0-9]+') IF length(x) >= 18]) AS n_access,
       len([x FOR x IN regexp_extract_all(t, '[0-9a-f]+') IF length(x) >= 16]) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
    "base_of_op10": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)
), often AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM w
)
SELECT c.doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(v.n, 0) > 50 * n_words AS base_failed
FROM counts c LEFT JOIN covered v USING (doc_id)
""",
    "op11_kdtree_clusters": clustering.ORACLE_SQL,
    "op12_count_rtree_join": ngram_join.ORACLE_SQL,
    "op13_trie_repair": conversations.ORACLE_SQL,
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
""",
}
