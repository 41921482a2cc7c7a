"""Line dedup by two Bloom filters.

The keys of the lines of a document become 128-bit digests. One filter holds the bits of keys seen at least once, the other those of
keys seen at least twice; both are built per task and merged by segments (bits that two tasks have seen once have been seen
twice). Only digests that pass the second filter are suspected repeats: they alone are shuffled, with their document, for the exact
test and the choice of the first document. False suspects cost a row in that shuffle and nothing else.

The filters have twelve bits per key up to MAX_BITS. Beyond about 90 million keys the share of false suspects grows (18 % at
300 million), at last every digest is suspected: the result stays the same, and the shuffle never holds texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.lineage import settle, sized
from wardlog.llm.common import LOWER, rows_out, slices

MIN_POINTS = 10
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
BITS_PER_KEY, HASHES = 12, 3
#: Bound of a filter (128 MB; it is mostly zeros and travels compressed), and of the piece of it that is merged at once.
MIN_BITS, MAX_BITS, SEGMENT_BITS = 1 << 16, 1 << 30, 1 << 20
#: Load only: digests with more documents than this are looked up apart from the others.
HOT_DOCS = 100_000
DIGEST = 16


def line_keys(text: bytes, min_points: int = MIN_POINTS) -> list[bytes | None]:
    """For each line its digest, or None if its key is too short to count."""
    out: list[bytes | None] = []
    for line in text.translate(LOWER).split(b"\n"):
        key = line.strip(BLANKS)
        size = len(key)
        if size < min_points or (size < 4 * min_points and not key.isascii() and len(key.decode("utf-8", "replace")) < min_points):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


class SeenTwice:
    """The two filters of a task."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    @staticmethod
    def places(digests: np.ndarray, bits: int) -> np.ndarray:
        """(keys, HASHES) bit numbers of digests given as pairs of 64-bit words."""
        step = digests[:, 1:] | np.uint64(1)
        return ((digests[:, :1] + step * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)

    @staticmethod
    def has(filter_bytes: np.ndarray, places: np.ndarray) -> np.ndarray:
        return ((filter_bytes[places >> 3] >> (places & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)

    @staticmethod
    def put(filter_bytes: np.ndarray, places: np.ndarray) -> None:
        bits = np.unique(places)
        cells = bits >> 3
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(bits) else np.zeros(0, np.int64)
        if len(starts):
            filter_bytes[cells[starts]] |= np.bitwise_or.reduceat(np.left_shift(1, bits & 7).astype(np.uint8), starts)

    def add(self, digests: np.ndarray) -> None:
        """Each row is a key of one document; a key that comes again, here or before, goes to the second filter."""
        if not len(digests):
            return
        places = self.places(digests, self.bits)
        seen = self.has(self.once, places)
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        again = np.zeros(len(digests), bool)
        again[order[1:]] = (digests[order[1:]] == digests[order[:-1]]).all(axis=1)
        self.put(self.twice, places[seen | again])
        self.put(self.once, places)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Pieces in which any bit is set, compressed."""
        step = min(SEGMENT_BITS, self.bits) // 8
        for number in range(self.bits // 8 // step):
            once, twice = (f[number * step : (number + 1) * step] for f in (self.once, self.twice))
            if once.any():
                yield number, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def merged_twice(rows: Iterator[tuple[bytes, bytes]]) -> bytes:
    """The second filter of all tasks for one segment."""
    once = twice = None
    for a, b in rows:
        first, second = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
        once, twice = (first, second) if once is None else (once | first, twice | second | (once & first))
    return zlib.compress(twice.tobytes(), 1)


def filter_bits(keys: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, max(MIN_BITS, 1 << (max(1, keys * BITS_PER_KEY) - 1).bit_length()))


def _pairs(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u8").reshape(-1, 2)


def _owner() -> list[Column]:
    """A document is its id; without id each text stands for itself."""
    return [F.col("_id"), F.when(F.col("_id").isNull(), F.md5(F.coalesce("_text", F.lit("").cast("binary")))).otherwise(F.lit("")).alias("_own")]


def _suspects(prints: DataFrame, bits: int, segments: DataFrame) -> DataFrame:
    """_id, _own, digest of the keys that pass the filter of keys seen twice."""
    step = min(SEGMENT_BITS, bits) // 8
    # Bounded by MAX_BITS, and compressed.
    parts = {r["segment"]: bytes(r["twice"]) for r in segments.collect()}
    shipped = prints.sparkSession.sparkContext.broadcast(parts)
    arrow = pa.schema([prints_field(prints, "_id"), ("_own", pa.string()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.zeros(bits // 8, np.uint8)
        for number, piece in shipped.value.items():
            twice[number * step : (number + 1) * step] = np.frombuffer(zlib.decompress(piece), np.uint8)
        for piece in slices(batches):
            packed = piece.column(2).to_pylist()
            sizes = np.array([len(p) // DIGEST for p in packed], np.int64)
            digests = _pairs(b"".join(packed))
            if len(digests):
                passed = np.flatnonzero(SeenTwice.has(twice, SeenTwice.places(digests, bits)))
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes)[passed])
                raw = digests[passed].tobytes()
                cut = pa.array([raw[k : k + DIGEST] for k in range(0, len(raw), DIGEST)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0).take(row), piece.column(1).take(row), cut], schema=arrow)

    return prints.mapInArrow(run, f"_id {prints.schema['_id'].dataType.simpleString()}, _own string, digest binary")


def prints_field(frame: DataFrame, name: str) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(name, to_arrow_type(frame.schema[name].dataType))


def repeated_keys(docs: DataFrame, min_points: int = MIN_POINTS, max_bits: int = MAX_BITS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """_id, _own, drops: for each document (_id, _text as binary) the digests of lines that an earlier document holds."""
    kind = docs.schema["_id"].dataType.simpleString()
    owned = docs.select(*_owner(), "_text")
    arrow = pa.schema([prints_field(owned, "_id"), ("_own", pa.string()), ("keys", pa.binary())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            keys = [b"".join(dict.fromkeys(k for k in line_keys(t, min_points) if k)) if t else b"" for t in piece.column(2).to_pylist()]
            yield rows_out(arrow, [piece.column(0).to_pylist(), piece.column(1).to_pylist(), keys])

    prints = settle(owned.mapInArrow(digest, f"_id {kind}, _own string, keys binary").where(F.octet_length("keys") > 0))
    bits = filter_bits(int(prints.agg(F.sum(F.octet_length("keys")) / DIGEST).first()[0] or 0), max_bits)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = SeenTwice(bits)
        for piece in slices(batches):
            filters.add(_pairs(b"".join(piece.column(0).to_pylist())))
        for number, once, twice in filters.segments():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([number], pa.int32()), "once": pa.array([once], pa.binary()), "twice": pa.array([twice], pa.binary())})

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((a, b) for batch in batches for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True))
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int32()), "twice": pa.array([merged_twice(rows)], pa.binary())})

    segments = settle(prints.select("keys").mapInArrow(seen, "segment int, once binary, twice binary").groupBy("segment").applyInArrow(merge, "segment int, twice binary"))
    suspects = settle(_suspects(prints, bits, segments))
    place = F.struct(F.col("_id").isNull().alias("late"), "_id")
    confirmed = settle(suspects.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("held"))
                       .where("first != last").select("digest", "first", "held"))
    # A line of very many documents would be one task of the join; there are few such lines.
    hot = sized(settle(confirmed.where(F.col("held") > hot_docs).select("digest", F.col("first").alias("hot_first"))))
    looked = suspects.join(hot, "digest", "left")
    others = looked.where(F.col("hot_first").isNull()).drop("hot_first").join(confirmed.where(F.col("held") <= hot_docs).select("digest", "first"), "digest")
    known = looked.where(F.col("hot_first").isNotNull()).withColumnRenamed("hot_first", "first").unionByName(others)
    return known.where(place > F.col("first")).groupBy("_id", "_own").agg(F.collect_set("digest").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, max_bits: int = MAX_BITS,
                hot_docs: int = HOT_DOCS) -> DataFrame:
    """One row per document: id, text without the dropped lines, n_lines (before), n_dropped.

    A key is a line without blanks at its ends and with A-Z in lower case. Keys of at least `min_points` code points that two or
    more ids hold lose all their lines but in the smallest id; that document keeps all of them. Null and empty texts are one empty
    line and return as empty text. Rows that repeat an id are one document and are treated alike; rows without id are
    one document behind all others. Other columns are not read; empty tables give no rows.
    """
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    drops = repeated_keys(texts, min_points, max_bits, hot_docs)
    drops = sized(settle(drops.select(F.col("_id").alias("_drop_id"), F.col("_own").alias("_drop_own"), "drops")))
    owned = texts.select(*_owner(), "_text")
    marked = owned.join(drops, F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_own") == F.col("_drop_own")), "left").select("_id", "_text", "drops")
    arrow = pa.schema([pa.field(id_col, prints_field(texts, "_id").type), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            kept, sizes, gone = [], [], []
            for text, away in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                text = text or b""
                if away:
                    lines, away = text.split(b"\n"), set(away)
                    left = [line for line, key in zip(lines, line_keys(text, min_points), strict=True) if key not in away]
                    kept.append(b"\n".join(left))
                    sizes.append(len(lines))
                    gone.append(len(lines) - len(left))
                else:
                    kept.append(text)
                    sizes.append(text.count(b"\n") + 1)
                    gone.append(0)
            texts_out = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(arrow.field(0).type), texts_out, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], schema=arrow)

    return marked.mapInArrow(rewrite, f"`{id_col}` {kind.simpleString()}, text string, n_lines long, n_dropped long")
