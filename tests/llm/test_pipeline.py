"""The whole pipeline over odd rows, repeated rows, clashing columns and empty tables."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from llm_tables import ODD, SCHEMA, empty_frame, prose, rows

import corpus_pipeline
from wardlog.llm import bpe

PASSAGE = " ".join(f"shared{k}" for k in range(70)) + "."


def tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b1", " ".join(f"leak{k}" for k in range(14))), (None, "no id"), ("b2", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_over_odd_rows(spark, tmp_path):
    rng = random.Random(12)
    texts = [*ODD, *(prose(rng, 12) for _ in range(25))]
    copy, leak = len(texts), len(texts) + 1
    texts += [texts[-1], "before it " + " ".join(f"Leak{k}" for k in range(14)) + " behind it", prose(rng, 3) + "\n" + PASSAGE + "\n" + prose(rng, 3), prose(rng, 3) + "\n" + PASSAGE + "\n" + prose(rng, 3)]
    table = rows(texts)
    table += [table[20], (None, "no id here at all", None, None, None, None, None, None), (None,) * 8]
    folder = tables(spark, tmp_path, spark.createDataFrame(table, SCHEMA).repartition(3))
    got = corpus_pipeline.run(spark, folder).collect()
    left = {r["doc_id"] for r in got}
    assert copy not in left and leak not in left and {copy - 2, leak + 1, leak + 2, None} <= left and len([r for r in got if r["doc_id"] == 20]) == 1
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    last = {r["doc_id"]: bytes(r["ids"]) for r in got}
    assert memoryview(last[leak + 1]).cast("I").tolist() == reference.encode_ordinary(texts[leak + 1])
    cut = reference.decode(memoryview(last[leak + 2]).cast("I").tolist())
    assert "shared9" not in cut and all(r["decoded_sha256"] == hashlib.sha256(reference.decode(memoryview(bytes(r["ids"])).cast("I").tolist()).encode()).hexdigest() for r in got)


def test_run_over_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, empty_frame(spark))).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:4]])
def test_stages_keep_the_columns(spark, tmp_path, stage):
    docs = empty_frame(spark)
    assert stage(spark, docs, tables(spark, tmp_path, docs)).columns == docs.columns
