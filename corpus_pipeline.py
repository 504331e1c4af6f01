"""A training corpus in five stages, each written and read again before the next.

1. quality rules: documents that the rules reject go;
2. near-duplicates: of each group (five-word shingles, similarity 0.8) one document stays;
3. benchmark decontamination: documents that hold a window of a test item go;
4. secret scan: secrets in the texts are replaced by their kind, and n_chars follows;
5. BPE: what stays is encoded and decoded; token counts and digests come out.

Stages 1 to 4 return the columns of their input, extra columns too. Repeated rows of one id count as
one from stage 2 on. Null and empty texts go in stage 1. Empty tables give empty tables; without
labels stage 1 goes by the base rules, without benchmark items stage 3 keeps all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtide.llm import bpe, decontaminate as leaks, near_dedup, quality_rules as rules, secret_scan
from jobtide.llm.common import fresh_names, table
from jobtide.session import cut

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = rules.fit(docs, table(spark, sf_dir, "labels"))
    verdict, = fresh_names(docs, "verdict")
    return rules.judge(docs, model, into=verdict).where(F.col(verdict)["kept"]).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leak, = fresh_names(docs, "leak")
    found = leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"), into=leak)
    return found.where(F.size(F.col(leak)["runs"]) == 0).drop(leak)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, bpe.load_vocabulary(public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", secrets),
    ("tokens", tokens),
]

ORACLE_SQL = None  # a trained line model and sketches are not SQL; tests compare with plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
