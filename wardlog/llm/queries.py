"""Registered queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.llm import alignment, bpe, decontaminate, language, licenses, lines_once, minhash, simhash, spelling, substrings, token_counts, toxicity, url_filter


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_matches(table(spark, folder, "documents"))
    return found.select("doc_id", "license", "coverage", "start", "end", F.size("spans").alias("n_matched_words"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = substrings.cut_repeats(docs)
    return cut.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), "kept", "removed")


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"))


def op4_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, folder, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    pieces = token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, folder, "documents"), token_counts.unigram_scores(pieces))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    model = language.fit_text_model(table(spark, folder, "documents"))
    return language.identify_pages(table(spark, folder, "pages"), model)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    grammar = toxicity.fit_grammar(docs, table(spark, folder, "labels"))
    scored = toxicity.score_documents(docs, grammar)
    return scored.select("doc_id", (toxicity.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode_documents(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines_once.dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as first, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as second:
        return alignment.aligned_links(table(spark, folder, "documents"), first.read(), second.read())


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_url_filter, op4_document_fingerprints, op5_simhash_near_dedup, op6_token_counts,
                            op7_language_id, op8_toxicity, op9_byte_bpe, op10_benchmark_decontamination, op11_spelling_variants, op12_line_dedup,
                            op13_tokenizer_alignment, pipeline)}

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def url_filter_sql() -> str:
    rules = sorted(url_filter.DEFAULT_RULES, key=lambda r: (-len(r.name), r.action != "block"))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    named = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, rules, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.action}'" for f, r in zip(fits, rules, strict=True))
    return f"""
    WITH parts AS (
      SELECT page_id, {LOWER_SQL.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages)
    SELECT page_id, host, path, CASE {named} ELSE NULL END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM parts"""


DECONTAMINATION_SQL = rf"""
    WITH item_words AS (
      SELECT item_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
    windows AS (
      SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[s : s + least(10, len(ws)) - 1], ' ') AS body
      FROM item_words, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(s) WHERE len(ws) > 0),
    doc_words AS (
      SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    grams AS (
      SELECT rid, p, n AS size, array_to_string(ws[p : p + n - 1], ' ') AS body
      FROM doc_words, (SELECT DISTINCT size AS n FROM windows), unnest(range(1, len(ws) - n + 2)) AS u(p)),
    hits AS (SELECT rid, p, size, item_id FROM grams JOIN windows USING (size, body)),
    counted AS (SELECT rid, count(DISTINCT w) AS n_hit FROM hits, unnest(range(p, p + size)) AS u(w) GROUP BY rid),
    named AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hits) GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc_words LEFT JOIN counted USING (rid) LEFT JOIN named USING (rid)"""

LINE_DEDUP_SQL = f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lines AS (
      SELECT rid, doc_id, i, ls[i] AS line, {LOWER_SQL.format("trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
      FROM docs, unnest(range(1, len(ls) + 1)) AS u(i)),
    repeated AS (SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    judged AS (SELECT rid, doc_id, i, line, coalesce(doc_id > first_id, FALSE) AS goes FROM lines LEFT JOIN repeated USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (goes))::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
    FROM judged GROUP BY rid"""

ORACLES: dict[str, str] = {"op3_url_filter": url_filter_sql(), "op10_benchmark_decontamination": DECONTAMINATION_SQL,
                           "op12_line_dedup": LINE_DEDUP_SQL}

