"""The corpus pipeline: documents through five operators, each stage written and reread.

quality keeps the documents that the base rule and the learned rules keep; near_duplicates keeps
one document of each group of near-duplicates (five-word shingles, similarity 0.8 or more);
decontamination drops contaminated documents; secrets masks every secret span (and corrects
n_chars); tokens returns doc_id, lang, source, the decoded text's digest and the token ids.

In every stage null texts count as empty, and repeated rows are treated alike; rows that share a
key are one document; a null key never joins a group. Ties go to the smallest key. Columns beyond
those of documents are dropped at the start, so no name can clash. Empty tables give empty tables.
Texts are worked on whole, however long.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptmill.checkpoints import shared_folder
from conceptmill.llm import bpe, decontam, quality, secrets, simhash
from conceptmill.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep; without labels, the base rule alone. Empty texts go."""
    docs = docs.select(*COLUMNS)
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, rules).filter("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest key; rows with a null key stay; texts without words are copies of each other."""
    return simhash.near_representatives(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; an empty benchmark drops nothing, an empty text is clean."""
    found = decontam.find_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("hit_spans") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secret spans masked; n_chars is counted anew where a span was masked. Null texts stay null."""
    found = secrets.scan(docs.select(*COLUMNS))
    masked = found.withColumn("text", secrets.redacted(F.col("text"), F.col("secret_spans")))
    return masked.withColumn("n_chars", F.when(F.size("secret_spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, text_sha256, token_ids) of every document; an empty text has no tokens."""
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id", "lang", "source", "n_chars"], with_decoded=True)
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("text_sha256"), "token_ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]
#: The learned rules, the fingerprints and the tokens are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, in order; each stage's result is written as Parquet and reread."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return docs
