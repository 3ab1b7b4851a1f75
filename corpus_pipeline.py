"""A corpus from raw documents: toxic texts out, one of each group of near copies, benchmark passages
out, personal data masked, and the rest as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
in the shared folder and reads it again as the next stage's docs. All stages but the last return the
columns of documents. Stages judge what their predecessor kept, and nothing else is dropped.

Null texts count as empty ones, which no stage drops; a null doc_id is an id of its own kind. Rows that repeat
a doc_id are judged by their own texts, but for contamination, where all rows of an id go with one. Equal rows are
one row after near_dedup. Empty tables pass; texts of any length are read whole. Further columns, of any type and name, pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, minhash, pii, sentencepiece_codec, toxicity
from tidewell.llm.common import materialize, table
from tidewell.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from all labelled documents, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id.

    Texts alone link documents: rows that repeat a doc_id with other texts are judged each by its own, and of rows that repeat both one stays.
    """
    return minhash.first_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    found = decontaminate.judge(decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")))
    gone = found.where("contaminated").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    masked = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every document left."""
    return sentencepiece_codec.digest_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("sentencepiece", tokenize),
]

#: The learned and iterative stages have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
