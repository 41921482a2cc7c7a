"""Document fingerprints: one-permutation MinHash with optimal densification, in DataFrame functions only.

Every shingle is hashed once; its top bits name a bin, and the smallest hash of each bin is kept. An empty bin copies from the
first filled bin in its own fixed random order of the bins. The low-order bits of every bin are packed into 64-bit words; the
share of equal bins, corrected for chance agreement of so few bits, estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.llm.common import let

SHINGLE = 5
BINS = 256
BITS = 8
#: Donor bins tried one after the other; an empty bin that finds none takes the filled bin that is first in a hashed order.
TRIES = 8
LOW = (1 << 56) - 1
#: Documents in one bucket of neighbouring ids, and buckets at most.
BUCKET_ROWS, MAX_BUCKETS = 2000, 1 << 16


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """One hash per shingle of lower-cased words (repeats included); of fewer words, but not none, one for all of them."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def of(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))
        return F.when(n >= 1, many).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def filled(value: Column) -> Column:
    return value.bitwiseAND(LOW) != LOW


def sketch(text: Column, shingle: int = SHINGLE) -> Column:
    """Packed fingerprint: an array of 64-bit words with 8 bins each; empty without words."""
    # a value that closes each bin: no real hash of the bin is greater, so it comes first only in an empty bin
    ends = F.array(*[F.lit(((b - BINS // 2) << 56) | LOW) for b in range(BINS)])

    def first_of_bin(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))

    def dense(v: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            donors = [F.get(v, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(1, TRIES + 1)]
            last = F.array_min(F.transform(F.filter(v, filled), lambda y: F.struct(F.xxhash64(i, F.lit(0), F.shiftright(y, 56)).alias("r"), y.alias("y"))))["y"]
            return F.when(filled(x), x).otherwise(F.coalesce(*[F.when(filled(d), d) for d in donors], last))

        return F.when(F.exists(v, filled), F.transform(v, value))

    def packed(v: Column) -> Column:
        def word(g: Column) -> Column:
            out = None
            for k in range(8):
                byte = F.shiftleft(F.get(v, g * 8 + k).bitwiseAND((1 << BITS) - 1), 8 * (7 - k))
                out = byte if out is None else out.bitwiseOR(byte)
            return out

        return F.when(v.isNull(), F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), word))

    return let(shingle_hashes(text, shingle), lambda h: let(F.sort_array(F.concat(h, ends)), lambda s: let(first_of_bin(s), lambda v: let(dense(v), packed))))


def as_hex(print_: Column) -> Column:
    """Two hexadecimal digits per bin; the empty string for a text without words."""
    return F.array_join(F.transform(print_, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Estimate of the Jaccard similarity from two sketches, 0 to 1; two empty ones are alike, an empty and another are not."""
    def equal_bins(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for s in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, s))
        return F.lit(8) - F.bit_count(z.bitwiseAND(0x0101010101010101))

    share = F.aggregate(F.zip_with(left, right, equal_bins), F.lit(0), lambda a, b: a + b) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return (F.when((F.size(left) == 0) | (F.size(right) == 0), (F.size(left) == F.size(right)).cast("double"))
            .otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id and its sketch (array of words). Null counts as empty; other columns are not read; no shuffle."""
    return docs.select(F.col(id_col), sketch(F.col(text_col).cast("string"), shingle).alias("sketch"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likenesses.

    One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    ends with the first floor(n_chars / 2) characters of the next document by id (the first after the last) instead of its own last
    ones. Null texts are empty. Rows without id come first; rows that repeat an id follow each other in the order of their texts.
    A single row is its own next. The id is an integer column; other columns are not read.

    Documents are dealt into buckets of neighbouring ids (bounds from a sketch of the id distribution), and the first rows of
    a bucket also visit the bucket before it. So the text is shuffled once and no task sees more than a bucket.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    key = F.coalesce("_id", F.lit(-(1 << 63)))
    rows = base.count()
    buckets = max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))
    bounds = []
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        bounds = sorted(set(base.select(F.percentile_approx("_id", shares, max(10_000, 10 * buckets))).first()[0] or []))
    known = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    # binary search for the number of bounds at or below the id
    bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(known, at + s - 1) <= key, at + s).otherwise(at)) if steps else F.lit(0)
    placed = base.select(key.alias("_k"), "_id", "_text", bucket.alias("_bucket"))
    firsts = placed.groupBy("_bucket").agg(F.min("_k").alias("_min"))
    # at most MAX_BUCKETS rows; every bucket with the one before it, the first with the last
    starts = sorted((r["_bucket"], r["_min"]) for r in firsts.collect())
    before = {b: starts[k - 1][0] for k, (b, _) in enumerate(starts)}
    visits = docs.sparkSession.createDataFrame([(b, m, before[b]) for b, m in starts], "_bucket int, _min bigint, _before int")
    joined = placed.join(F.broadcast(visits), "_bucket")
    seats = F.when(F.col("_k") == F.col("_min"), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest")),
                                                         F.struct(F.col("_before").alias("b"), F.lit(True).alias("guest")))
                   ).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest"))))
    seated = joined.select("_k", "_id", "_text", F.inline(seats).alias("_b", "_guest"))
    order = Window.partitionBy("_b").orderBy("_guest", "_k", "_text")
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = seated.withColumn("_next", F.lead("_text").over(order)).withColumn(
        "_edited", F.when(~F.col("_guest"), F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring("_next", F.lit(1), half))))
    printed = edited.select("_k", "_id", "_b", "_guest", "_text", F.length("_text").cast("bigint").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
                            sketch(F.col("_text"), shingle).alias("_own"), F.when(~F.col("_guest"), sketch(F.col("_edited"), shingle)).alias("_new"))
    after = printed.withColumn("_after", F.lead("_own").over(order)).where("not _guest")
    return after.select(F.col("_id").alias(id_col), "n_chars", "edited_sha256", as_hex(F.col("_own")).alias("fingerprint"), as_hex(F.col("_new")).alias("edited_fingerprint"),
                        likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_after")).alias("near_next"))
