"""The registered queries of the corpus operators: thin wrappers that derive the contracts' columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import bpe, decontaminate, langid, licenses, minhash, pii, quality, secrets, sharding, simhash, substring, tries, vectorcodes
from strandflow.llm.common import id_and_text, read
from strandflow.llm.oracles import ORACLE_SQL  # noqa: F401

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(id_and_text(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.transcode(id_and_text(read(spark, sf_dir, "documents")), VOCABULARY)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(id_and_text(read(spark, sf_dir, "documents")))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[pii.count_of(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.written(pii.base_of(spans)), 256).alias("base_sha256"),
        pii.written(spans).alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(id_and_text(read(spark, sf_dir, "documents")))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[secrets.count_of(spans, k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(secrets.written(secrets.base_of(spans)), 256).alias("base_sha256"),
        secrets.written(spans).alias("spans"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(id_and_text(read(spark, sf_dir, "documents")), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = langid.is_held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(id_and_text(read(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(id_and_text(read(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(id_and_text(read(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.dedup(id_and_text(read(spark, sf_dir, "documents")), window=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(id_and_text(read(spark, sf_dir, "documents"))).select("doc_id", "n_shingles", "component_id", "kept")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(read(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress(read(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", vectorcodes.hexadecimal(F.col("codes")).alias("code"), "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_secrets": op4_secrets,
    "op5_sharding": op5_sharding,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_substring": op10_substring,
    "op11_minhash": op11_minhash,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_vector_codes": op13_vector_codes,
}
