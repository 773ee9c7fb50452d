"""Queries of the numbered operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest
from tidemark.llm.common import shared_folder
from tidemark.llm.decontam import contamination, is_contaminated
from tidemark.llm.divergence import source_divergence
from tidemark.llm.langid import predict_languages, train_language_model
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.oracles import DIVERGENCE_SQL, LINKS_SQL, REPAIR_SQL
from tidemark.llm.pitman_yor import score_texts
from tidemark.llm.sharding import shard_documents
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_files import token_digests, write_token_files
from tidemark.llm.turns import damage, repair
from tidemark.llm.vector_links import vector_links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


MIX_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('mix:' || doc_id), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sizes),
capped AS (SELECT *, [3.0, 1.0, 2.0][CAST((k - 1) % 3 + 1 AS INT)]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
            sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT max(level) FROM levels WHERE level <= cap / w) * w, cap)) AS target FROM levels),
shares AS (
  SELECT r.*, t.source_size, t.target, floor(least(2.0, t.target * 1.0 / t.source_size)) AS sure,
         least(2.0, t.target * 1.0 / t.source_size) - floor(least(2.0, t.target * 1.0 / t.source_size)) AS rest
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, CASE WHEN rest > 0 THEN u / (1 - u) / (rest / (1 - rest)) ELSE 'inf'::DOUBLE END AS rank_value FROM shares),
summed AS (
  SELECT *, target - sum(size * sure) OVER (PARTITION BY source) AS wanted,
         sum(CASE WHEN sure < 2 THEN size ELSE 0 END)
           OVER (PARTITION BY source ORDER BY rank_value, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM ranked)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       CAST(size * (sure + CASE WHEN sure < 2 AND upto - size / 2.0 <= wanted THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed"""


@registered("op3_pareto_mixture", MIX_SQL)
def op3_pareto_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of the corpus takes of each document."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_copies=2)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


@registered("op4_benchmark_index")
def op4_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in 13-word windows of benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    found = found.withColumns({"n_hit": F.size("hits").cast("long"), "n_items": F.size("items").cast("long")})
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


@registered("op10_minimax_shards")
def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of near equal bytes, equal texts together."""
    placed = shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@registered("op6_bpe_token_counts")
def op6_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every text."""
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@registered("op8_orc_token_files")
def op8_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all token ids, read back from the ORC files they were written to."""
    path = shared_folder(spark, "token-ids")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_digests(spark, path)


@registered("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out")
    model = train_language_model(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict_languages(docs, model, keep=(held_out,)).select("doc_id", "held_out", "lang_pred", "score")


@registered("op7_circulant_minhash")
def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all texts by four-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@registered("op1_adaptive_scan_ann")
def op1_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the largest inner product for every twentieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@registered("op2_pitman_yor_scores")
def op2_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all texts by a model of the rows that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    scores = score_texts(table(spark, sf_dir, "documents"), held_out)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@registered("op5_bwt_passage_dedup")
def op5_bwt_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that lie in 50-byte strings of earlier documents."""
    kept = remove_repeats(table(spark, sf_dir, "documents"), 50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@registered("op11_source_stripes", DIVERGENCE_SQL)
def op11_source_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language, and the terms that tell a source from its language."""
    return source_divergence(table(spark, sf_dir, "documents"), least=3, top=200)


@registered("op12_principal_tiles", LINKS_SQL)
def op12_principal_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors that reach a cosine of 0.98 within their label."""
    found = vector_links(table(spark, sf_dir, "embeddings"), 0.98)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@registered("op13_turn_repair", REPAIR_SQL)
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest edits that make the roles of damaged conversations alternate."""
    conversations = table(spark, sf_dir, "conversations")
    return repair(damage(conversations), conversations.select("conv_id"))
