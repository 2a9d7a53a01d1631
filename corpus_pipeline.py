"""Corpus pipeline: each stage works on all that the one before it kept.

All stages but the last return the columns of documents. Null or empty texts have no language and go in the first stage;
repeated rows leave one row at the second; an empty table passes through empty; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import bpe, decontaminate, langid, pii, resemblance
from strandflow.llm.common import materialise, release, scope
from strandflow.llm.queries import VOCABULARY

#: A document whose best language holds a smaller share of its n-grams is in none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language."""
    model = langid.fit(docs)
    judged = langid.predict(docs, model, lang="__lang", score="__score")
    return judged.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose five-word shingles are 0.8 similar, or more, to those of a kept one."""
    return resemblance.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by placeholders; n_chars follows."""
    clean = pii.redact(docs)
    return clean.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else clean[c] for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, and what they decode to."""
    coded = bpe.transcode(docs, VOCABULARY, ids="ids", decoded="decoded")
    return coded.select("doc_id", "lang", "source", "text", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", redact_personal_data),
    ("tokens", encode_tokens),
]

#: Stages in Python cannot be stated in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Tables that a stage writes go with it, but for its result, which goes with the next stage's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nth, (_, stage) in enumerate(STAGES[:-1]):
        with scope() as kept:
            done = materialise(stage(spark, docs, sf_dir))
            kept.append(done)
        if nth:
            release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
