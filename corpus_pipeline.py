"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, mixing.

Each stage works on all that its predecessor kept, and each but the last returns the columns of documents. Toxic documents
go; one document of each group of near-duplicates stays (the one with the smallest id); documents with a passage of the
benchmark go; personal data are replaced by their kinds; the rest is mixed to target weights, the square roots of the sources'
sizes, and gets its place in the mix.

Null texts pass every filter as empty texts, of which the near-duplicate stage keeps one (they share a fingerprint); empty tables give empty
results; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm import decontam, mixing, pii, simhash_dedup, toxicity
from wirelake.llm.common import stash, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = pii.redact(docs)
    return new.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else new


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.weights_of(spark, docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]
#: SQL can express neither compression nor fingerprints; tests hold every stage against its operator or a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
