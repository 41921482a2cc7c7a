"""Language ID of web pages: Bayesian fusion of text, declared markup, address and host.

Text: a naive Bayes model over hashed character trigrams, fitted on labelled documents. Declared: the `lang` attribute of the
page. Address: a language segment of the path, or a country suffix. Host: a prior from grouped counts, smoothed from host to
registered domain to suffix to all pages; a page's own vote is left out of its prior. The four are added as log probabilities.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.lineage import settle
from wardlog.llm.common import map_slices
from wardlog.llm.url_filter import url_host, url_path

LANGUAGES = ("de", "en", "es", "fr")
TABLE = 1 << 16
#: Labelled documents read by the fit, about; of larger tables an even share by a hash of the id.
FIT_ROWS = 20_000
#: A declared or address language is right this often; weight of the text per trigram is capped at this many nats in all.
DECLARED_RIGHT, ADDRESS_RIGHT, TEXT_NATS = 0.8, 0.8, 12.0
#: Pseudo-counts handed down from the wider to the narrower level.
SMOOTHING = 5.0
#: Country suffixes that speak for a language (fixed values).
SUFFIXES = {"de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "uk": "en", "us": "en", "au": "en", "ie": "en"}
HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(?:script|style)\b.*\Z|<[^>]*>")


def page_text(markup: str | None) -> str:
    """Text of a page without tags, comments, scripts and styles; entities are resolved."""
    return html.unescape(HIDDEN.sub(" ", markup)) if markup else ""


def trigram_slots(text: str) -> np.ndarray:
    """Table slots of the character trigrams of the lower-cased text; digits, marks and blanks all count as a blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter = (codes >= 97) & (codes <= 122) | (codes >= 0xC0)
    codes = np.where(letter, codes, 32)
    if len(codes) > 1:  # runs of blanks are one blank
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(np.int64)


class TextModel:
    """Log probabilities of table slots by language."""

    def __init__(self, counts: np.ndarray, languages: tuple[str, ...] = LANGUAGES):
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=0)).astype(np.float64)

    def evidence(self, text: str) -> list[float]:
        """Log likelihoods up to a constant, at most TEXT_NATS apart; all zero without trigrams."""
        slots = trigram_slots(text)
        if not slots.size:
            return [0.0] * len(self.languages)
        sums = self.table[slots].sum(axis=0)
        sums = sums - sums.max()
        return np.maximum(sums, -TEXT_NATS).tolist()


def fit_text_model(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> TextModel:
    """Trigram counts of about `fit_rows` labelled documents (table slots x languages numbers reach the driver)."""
    known = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    known = known.where(F.col("_lang").isin(*languages) & F.col("_text").isNotNull())
    share = min(1.0, fit_rows / max(1, docs.select(id_col).count()))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    arrow = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])

    def run(piece: pa.RecordBatch) -> list:
        sums = {}
        for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + np.bincount(trigram_slots(text), minlength=TABLE)
        out: list[list] = [[], [], []]
        for lang, counts in sums.items():
            slots = np.flatnonzero(counts)
            out[0] += [lang] * len(slots)
            out[1] += slots.tolist()
            out[2] += counts[slots].tolist()
        return out

    sums = map_slices(known.select("_lang", "_text"), run, "lang string, slot int, n long", arrow).groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = np.zeros((TABLE, len(languages)))
    for row in sums.collect():
        counts[row["slot"], languages.index(row["lang"])] = row["n"]
    return TextModel(counts, languages)


def _voted(source: Column, languages: tuple[str, ...], right: float) -> Column:
    """Log likelihood of a vote for one language, by language; zeros without a vote."""
    wrong = math.log((1 - right) / max(1, len(languages) - 1))
    return F.array(*[F.when(source.isin(*languages), F.when(source == lang, F.lit(math.log(right))).otherwise(F.lit(wrong))).otherwise(F.lit(0.0)) for lang in languages])


def address_language(host: Column, path: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """Language of the first path segment, else of the suffix of the host; null without one."""
    segment = F.lower(F.regexp_extract(path, r"^/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    by_suffix = F.lit(None).cast("string")
    for end, lang in SUFFIXES.items():
        by_suffix = F.when(suffix == end, F.lit(lang)).otherwise(by_suffix)
    return F.when(segment.isin(*languages), segment).otherwise(by_suffix)


def identify_pages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, lang, confidence (posterior of lang), text_lang, declared, address, host.

    Null and empty html gives no text and no declared language; a null or malformed url has an empty host, which shares the
    prior of all pages with empty hosts. Equal posteriors: the first language by name. Repeated rows each get their row; null
    ids stay; other columns are not read. Host, domain and suffix counts are grouped aggregations over all pages.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    langs = model.languages
    kind = pages.schema[id_col].dataType
    arrow = pa.schema([(id_col, to_arrow_type(kind)), ("host", pa.string()), ("path", pa.string()), ("declared", pa.string()), ("text_evidence", pa.list_(pa.float64()))])
    declared_in = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})")

    def run(piece: pa.RecordBatch) -> list:
        markup = piece.column(3).to_pylist()
        found = [declared_in.search(m) if m else None for m in markup]
        return [piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist(), [f[1].lower() if f else None for f in found],
                [model.evidence(page_text(m)) for m in markup]]

    parts = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(html_col).cast("string").alias("_html"))
    read = map_slices(parts, run, f"`{id_col}` {kind.simpleString()}, host string, path string, declared string, text_evidence array<double>", arrow)
    labels = F.array(*map(F.lit, langs))

    def best(scores: Column) -> Column:
        return F.get(labels, F.array_position(scores, F.array_max(scores)).cast("int") - 1)

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    own = add(add(F.col("text_evidence"), _voted(F.col("declared"), langs, DECLARED_RIGHT)), _voted(F.col("address"), langs, ADDRESS_RIGHT))
    read = read.withColumn("address", address_language(F.col("host"), F.col("path"), langs))
    read = read.withColumn("own", own).withColumn("vote", best(F.col("own")))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    read = settle(read.withColumn("domain", F.when(domain == "", F.col("host")).otherwise(domain)).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)).drop("path"))
    counts = {}
    for level in ("host", "domain", "suffix"):
        counts[level] = read.groupBy(level).agg(F.array(*[F.count_if(F.col("vote") == lang).cast("double") for lang in langs]).alias(f"{level}_n"))
    everything = read.agg(*[F.count_if(F.col("vote") == lang).cast("double").alias(lang) for lang in langs]).first()
    total = F.array(*[F.lit(float(everything[lang] or 0)) for lang in langs])
    fused = read
    for level in ("suffix", "domain", "host"):
        fused = fused.join(counts[level], level)
    mine = F.array(*[(F.col("vote") == lang).cast("double") for lang in langs])

    def handed_down(n: Column, wider: Column) -> Column:
        others = F.zip_with(n, mine, lambda a, b: a - b)
        size = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(others, wider, lambda a, p: (a + p * SMOOTHING) / (size + SMOOTHING))

    even = F.array(*[F.lit(1.0 / len(langs)) for _ in langs])
    prior = handed_down(F.col("host_n"), handed_down(F.col("domain_n"), handed_down(F.col("suffix_n"), handed_down(total, even))))
    scored = fused.withColumn("posterior", F.zip_with("own", prior, lambda a, p: a + F.log(p)))
    top = F.array_max("posterior")
    return scored.select(F.col(id_col), best(F.col("posterior")).alias("lang"),
                         (F.lit(1.0) / F.aggregate("posterior", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("confidence"),
                         F.when(F.array_max("text_evidence") > F.array_min("text_evidence"), best(F.col("text_evidence"))).alias("text_lang"),
                         "declared", "address", "host")
