"""Corpus pipeline: toxicity filter, near-dedup, substring dedup, benchmark decontamination, tokenization.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns documents with the same
columns (the last: their tokens). `run` writes each result as Parquet to the shared folder and reads it again.

Nulls in other columns pass through; extra columns stay, whatever their names; empty tables give empty tables in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.lineage import checkpoint_dir
from wardlog.llm import bpe, decontaminate, simhash, substrings, toxicity

#: SQL cannot express the hashes and the fit of the stages; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on the labels of these documents, does not reject.

    Null and empty texts have no clause, so they score like any text without one. Rows without id are scored too; rows that
    repeat are judged alike.
    """
    grammar = toxicity.fit_grammar(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, grammar)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    Null and empty texts are copies of each other, so one stays. Rows that repeat an id stay once for each different text; rows
    without id stay.
    """
    return simhash.keep_one(docs, groups=simhash.near_copies(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; n_chars follows the text; documents go of which the cut leaves nothing.

    Null and blank texts stay as they are. Rows that repeat both id and text keep the same text; rows without id come after all others.
    """
    cut = substrings.cut_repeats(docs)
    emptied = (F.size("removed") > 0) & (F.trim("text") == "")
    cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and empty texts stay; items without id or text are no windows."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers) and the digest of the decoded bytes; null and empty texts have no tokens."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeated_passages),
          ("benchmark_decontamination", drop_contaminated), ("byte_bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of each is written to spark.checkpoint.dir and read from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
