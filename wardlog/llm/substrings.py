"""Substring dedup: hash lines and parts of lines, group the digests globally, keep the earliest ranked occurrence, cut the rest.

Units, both of words with case and white space normalised:

* every line of `LINE_WORDS` words and more, as a whole;
* within the text, `WINDOW` words from places that its content chooses: of any `STEP` neighbouring windows the one with the
  smallest digest (winnowing), and the windows that start a line. Two texts that share a passage choose the same places inside
  it wherever it stands, in the middle of a sentence too, and whatever its punctuation and line breaks are.

A word is repeated if it lies in a unit that occurs earlier. Runs of `min_words` repeated words and more are cut. Guarantee: of a
passage of 51 words and more that occurs earlier, all but at most STEP - 1 words at each end go (a passage of
whole lines goes as a whole): 51 - 2 * (STEP - 1) words are more than MIN_WORDS.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlog.llm.common import slices

MIN_WORDS = 25
LINE_WORDS = 4
WINDOW, STEP = 12, 8
#: Load only: digests that a task combines before they are shuffled, and words whose hashes a task remembers.
COMBINED = 1 << 20
REMEMBERED = 1 << 20
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
WORD = re.compile(r"\S+")


class Words(dict):
    """Two 64-bit hashes of every word, by its number."""

    def __init__(self) -> None:
        self.hashes = np.zeros((1024, 2), np.uint64)

    def __missing__(self, word: str) -> int:
        number = len(self)
        if number == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
        value = xxhash.xxh3_128_intdigest(word.encode("utf-8", "surrogatepass"))
        self.hashes[number] = value & 0xFFFFFFFFFFFFFFFF, value >> 64
        self[word] = number
        return number


def split_lines(text: str) -> tuple[list[str], list[str], np.ndarray]:
    """Normalised lines and words, and for every line the number of its first word (and last the number of words)."""
    lines, words, starts = [], [], [0]
    for line in text.lower().split("\n"):
        own = line.split()
        lines.append(" ".join(own))
        words += own
        starts.append(len(words))
    return lines, words, np.array(starts, np.int64)


def chosen(values: np.ndarray) -> np.ndarray:
    """Which values are the smallest of some STEP neighbours (all values, if there are fewer)."""
    step = min(STEP, len(values))
    least = np.lib.stride_tricks.sliding_window_view(values, step).min(axis=1)
    padded = np.concatenate((np.zeros(step - 1, values.dtype), least, np.zeros(step - 1, values.dtype)))
    return values == np.lib.stride_tricks.sliding_window_view(padded, step).max(axis=1)


def digests(text: str | None, known: Words, unit: str = "passage") -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the units of a text (pairs of 64-bit words) and their places: twice the first word, plus 1 for a line."""
    if not text:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    lines, words, starts = split_lines(text)
    long = np.flatnonzero(np.diff(starts) >= LINE_WORDS)
    whole = b"".join(xxhash.xxh3_128_digest(lines[k].encode("utf-8", "surrogatepass"), 1) for k in long)
    prints, places = [np.frombuffer(whole, "<u8").reshape(-1, 2)], [starts[long] * 2 + 1]
    if unit == "passage" and len(words) >= WINDOW:
        if len(known) > REMEMBERED:
            known.clear()
        numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        hashes = known.hashes[numbers]
        count = len(words) - WINDOW + 1
        values = hashes[:count].copy()
        for k in range(1, WINDOW):
            values *= FACTORS
            values += hashes[k : k + count]
        values ^= values >> np.uint64(32)
        marked = chosen(values[:, 0])
        marked[starts[starts < count]] = True
        at = np.flatnonzero(marked)
        prints.append(values[at])
        places.append(at * 2)
    return np.concatenate(prints), np.concatenate(places)


def covered(places: list[int], starts: np.ndarray) -> np.ndarray:
    """For every word whether it lies in one of the units at `places`."""
    size = int(starts[-1])
    edges = np.zeros(size + 1, np.int64)
    for place in places:
        first = place >> 1
        edges[first] += 1
        edges[starts[np.searchsorted(starts, first, side="right")] if place & 1 else first + WINDOW] -= 1
    return np.cumsum(edges[:size]) > 0


def cut_ranges(text: str, places: list[int], min_words: int) -> list[tuple[int, int]]:
    """Character ranges of the runs of repeated words with at least `min_words` words.

    A run goes with the white space behind it; its last line break stays if other text stands before it on its first line.
    """
    spans = [m.span() for m in WORD.finditer(text)]
    starts = np.cumsum([0, *(len(line.split()) for line in text.split("\n"))])
    inside = np.concatenate(([False], covered(places, starts), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    out = []
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - first >= min_words:
            a, b = spans[first][0], spans[end - 1][1]
            after = spans[end][0] if end < len(spans) else len(text)
            alone = not text[text.rfind("\n", 0, a) + 1 : a].strip()
            out.append((a, after if alone or "\n" not in text[b:after] else b))
    return out


class Combined:
    """The digests of many documents of a task: of each digest the first place, and the other places as known repeats."""

    def __init__(self) -> None:
        self.owners: dict[tuple, int] = {}
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc: int | None, th: int, prints: np.ndarray, places: np.ndarray) -> None:
        owner = self.owners.setdefault((doc is None, doc or 0, th), len(self.owners))
        self.parts.append((owner, prints, places))
        self.size += len(places)

    def rows(self) -> pa.RecordBatch:
        """key1, key2, known, _id, _th, at."""
        names = list(self.owners)
        ranked = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[ranked] = np.arange(len(names))
        prints = np.concatenate([p for _, p, _ in self.parts])
        places = np.concatenate([p for _, _, p in self.parts])
        docs = np.repeat(rank[[o for o, _, _ in self.parts]], [len(p) for _, _, p in self.parts])
        order = np.lexsort((places, docs, prints[:, 1], prints[:, 0]))
        sorted_prints, sorted_places, sorted_docs = prints[order], places[order], docs[order]
        same = np.zeros(len(order), bool)
        same[1:] = (sorted_prints[1:] == sorted_prints[:-1]).all(axis=1)
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        # A row that comes twice is one document, not a repeat of itself.
        twin, known = np.zeros(len(order), bool), np.zeros(len(order), bool)
        twin[order[1:]] = same[1:] & (sorted_docs[1:] == sorted_docs[:-1]) & (sorted_places[1:] == sorted_places[:-1])
        known[order] = same & ((sorted_docs != sorted_docs[first]) | (sorted_places != sorted_places[first]))
        # Rows stay in the order of the documents: neighbours of one document compress well.
        prints, places, docs, known = prints[~twin], places[~twin], docs[~twin], known[~twin]
        ids = np.array([names[k][1] for k in ranked], np.int64)[docs]
        late = np.array([names[k][0] for k in ranked], bool)[docs]
        ths = np.array([names[k][2] for k in ranked], np.int64)[docs]
        # Known repeats need no group: their key only spreads them.
        prints = np.where(known[:, None], np.stack((ths, places), axis=1).view(np.uint64), prints)
        columns = [pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), pa.array(known), pa.array(ids, mask=late), pa.array(ths), pa.array(places)]
        return pa.RecordBatch.from_arrays(columns, names=["key1", "key2", "known", "_id", "_th", "at"])


def repeated_units(docs: DataFrame, unit: str = "passage") -> DataFrame:
    """(_id, _th, units): for every document the places of the units that occur earlier; documents without one are left out.

    Rank: id (null last), text hash, position. A task combines the digests of its documents (a million at a time) before the
    global grouping: only the first place of each goes there, the others are known to be repeats. So a passage that all documents share
    arrives once a task, as small rows that are ranked as they stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = Words(), Combined()
        for piece in slices(batches):
            for doc, th, text in zip(*(piece.column(k).to_pylist() for k in range(3)), strict=True):
                prints, places = digests(text, words, unit)
                if len(places):
                    block.add(doc, th, prints, places)
                if block.size >= COMBINED:
                    yield block.rows()
                    block = Combined()
        if block.size:
            yield block.rows()

    placed = docs.select("_id", "_th", "_text").mapInArrow(run, "key1 bigint, key2 bigint, known boolean, _id bigint, _th bigint, at bigint")
    order = Window.partitionBy("key1", "key2", "known").orderBy(F.col("_id").asc_nulls_last(), "_th", "at")
    later = placed.withColumn("nth", F.rank().over(order)).where("known or nth > 1")
    return later.groupBy("_id", "_th").agg(F.collect_set("at").alias("units"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, unit: str = "passage",
                spans: bool = True) -> DataFrame:
    """All rows and columns of `docs` with the repeated passages cut out of the text.

    With `spans`, also `kept` and `removed`: arrays of (start, end) in characters of the original text; the new text is the
    kept ranges one after the other. The earliest occurrence of a unit (by integer id, null last, then text hash, then position)
    does not count as repeated, also within one text; its words go all the same where they lie in other units that occur earlier.
    `unit="line"` hashes whole lines only. Rows that repeat both id and text count as one document and all keep the same text.
    Null and empty texts stay as they are. A text without white space is one word and stays.
    """
    at = docs.columns.index(text_col)
    keyed = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.struct(*docs.columns).alias("_row"))
    found = repeated_units(docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"),
                                       F.col(text_col).alias("_text")), unit)
    found = found.select(F.col("_id").alias("_fid"), F.col("_th").alias("_fth"), "units")
    both = keyed.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_th") == F.col("_fth")), "left").select("_row.*", F.col("units").alias("_units"))
    ranges = "array<struct<start: int, end: int>>"
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            columns, names = list(piece.columns)[:-1], list(piece.schema.names)[:-1]
            texts, kept, removed = [], [], []
            for text, repeats in zip(columns[at].to_pylist(), piece.column(piece.num_columns - 1).to_pylist(), strict=True):
                cut = cut_ranges(text, repeats, min_words) if repeats else []
                stay, last = [], 0
                for a, b in [*cut, (len(text or ""), 0)]:
                    if a > last:
                        stay.append((last, a))
                    last = b
                texts.append("".join(text[a:b] for a, b in stay) if cut else text)
                kept.append([{"start": a, "end": b} for a, b in stay])
                removed.append([{"start": a, "end": b} for a, b in cut])
            columns[at] = pa.array(texts, type=columns[at].type)
            if spans:
                columns, names = [*columns, pa.array(kept, type=pairs), pa.array(removed, type=pairs)], [*names, "kept", "removed"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    clash = {"kept", "removed", "_units"} & set(docs.columns)
    if spans and clash:
        raise ValueError(f"rename the columns {sorted(clash)} first, or ask for no spans")
    from pyspark.sql.types import StructType

    schema = StructType(docs.schema.fields)
    if spans:
        schema = StructType([*schema.fields, *StructType.fromDDL(f"kept {ranges}, removed {ranges}").fields])
    return both.mapInArrow(run, schema)
