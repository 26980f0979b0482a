"""The registered queries of the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtel.llm import (
    bpe,
    centroids,
    decontamination,
    exact_dedup,
    html_text,
    jaccard_join,
    language,
    licenses,
    oracles,
    pii,
    quality_rules,
    toxicity,
    warc,
    whitening,
)
from logtel.llm.common import remainder, stored, table
from logtel.session import new_path

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = warc.with_record_types(table(spark, sf_dir, "pages"))
    index = stored(warc.write_archives(typed, new_path(spark, "warc")), "warc-index")
    # a response answers with what its payload is, a revisit with what its headers say
    found = F.col("record_type") == "response"
    return warc.read_archives(spark, index).select(
        "page_id",
        F.when(found, F.octet_length("payload")).otherwise(F.col("n_bytes")).cast("bigint").alias("payload_bytes"),
        F.when(found, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    learned = language.prototypes(docs.filter(~held_out))
    return language.identify(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def count(spans: str, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[count("spans", kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
        *[count("base", kind).alias(f"n_base_{kind}") for kind in pii.KINDS],
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))


def byte_bpe(docs: DataFrame) -> DataFrame:
    """Encode and decode whole texts; what is returned are digests of the token ids and of the decoded bytes."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return bpe.round_trip(texts, VOCABULARY, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled documents that are not held out."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "worst_sentence",
        "n_offending",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("compared")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # null where the exact sum is beyond a long
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken"
    )


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc": op2_warc,
    "op3_licenses": op3_licenses,
    "op4_language": op4_language,
    "op5_personal_data": op5_personal_data,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_html_text": op7_html_text,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_centroids": op11_centroids,
    "op12_whitening": op12_whitening,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES: dict[str, str] = {
    "op2_warc": oracles.OP2,
    "op3_licenses": oracles.license_sql(),
    "op9_exact_dedup": oracles.OP9,
    "op11_centroids": oracles.cluster_sql(),
    "op13_quality_rules": oracles.quality_sql(),
}
