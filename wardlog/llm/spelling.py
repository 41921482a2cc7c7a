"""Spelling variant grouping by a bit-sliced position index.

The words of all documents are counted; words at one edit from each other are near. To find them, a bit set over the
vocabulary is kept per (position, letter). A word is read letter by letter against all words at once: one set of words has
agreed so far without error, and shifted copies of it have one replaced, one more or one missing letter. Every word so costs a
few wide bit operations per letter, whatever it is near to, and no pair is ever written: a word gets the number of its near
words and the most frequent one, which is the first bit set because the vocabulary of an index is sorted by frequency.

The vocabulary grows with the corpus, so it is cut into many indexes. Near words of lengths m and m or m + 1 share their first
half or their last half; groups that are still too large are halved again, down to one open letter. Where the first difference of
two words lies decides in which group the pair is counted, so it is counted once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.lineage import settle, sized

MIN_POINTS, MIN_COUNT, RATIO = 6, 5, 5
#: A run whose digest this number divides loses one letter.
TYPO_EVERY = 199
LETTERS = "A-Za-zÀ-ÿ"
#: Load only: letters of the words of one index (64 times fewer machine words per bit set), and words compared at once.
GROUP_LETTERS, BLOCK = 1 << 17, 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = "word string, n_near long, near string, near_n long"
NEAR_ARROW = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: letter runs of whole texts (A-Z in lower case, some with a letter left out) of enough letters and occurrences.

    Null and empty texts have no words; a null id stands as an empty string in the digest. Repeated rows count again.
    Other columns are not read. Counts are combined before the shuffle, so a frequent word is one row per task.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_owner"),
                       F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{min_points},}}"), F.lit(0))).alias("_run"))
    runs = runs.select("_owner", F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", UPPER, LOWER)).otherwise(F.col("_run")).alias("_run"))
    digest = F.crc32(F.concat("_owner", F.lit(":"), "_run").cast("binary"))
    at = (digest % F.length("_run")).cast("int")
    without = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    words = runs.select(F.when(digest % TYPO_EVERY == 0, without).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= min_points).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# --- one index -----------------------------------------------------------------------------------

class PositionIndex:
    """Bit sets over a word list: for each position and letter, the words that have the letter there."""

    def __init__(self, codes: np.ndarray):
        count = len(codes)
        self.width = -(-count // 64)
        self.letters, self.sets = [], []
        for column in codes.T:
            letters, at = np.unique(column, return_inverse=True)
            members = np.zeros((len(letters) + 1, self.width * 64), bool)  # the last row: a letter that no word has here
            members[at, np.arange(count)] = True
            members[:-1][letters == 0] = False  # behind the end of a word
            self.letters.append(letters)
            self.sets.append(self.pack(members))

    @staticmethod
    def pack(members: np.ndarray) -> np.ndarray:
        return np.packbits(members, axis=-1, bitorder="little").view("<u8")

    def having(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each given letter, the words that have it at the position."""
        known = self.letters[position]
        at = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        return self.sets[position][np.where(known[at] == letters, at, len(known))]


def near_in_group(words: list[str], counts: np.ndarray, shorter: int, head: int, tail: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of near words, and the position of the first of them in the list (-1 without).

    All words have `shorter` letters or one more; pairs with a word of `shorter` letters are counted whose first difference
    is at `head` or later and, unless `tail` is 0, before the last `tail` letters of the shorter word.
    """
    codes = np.array(words, dtype=f"U{shorter + 1}").view("<u4").reshape(len(words), shorter + 1)
    index = PositionIndex(codes)
    padded = np.zeros(index.width * 64, bool)
    padded[: len(words)] = codes[:, shorter] == 0
    short = index.pack(padded)
    padded[: len(words)] = codes[:, shorter] != 0
    longer = index.pack(padded)
    end = shorter - tail if tail else shorter + 1  # first differences lie before this position
    number, first = np.zeros(len(words), "i8"), np.full(len(words), -1, "i8")
    step = max(1, BLOCK // index.width)

    def note(rows: np.ndarray, near: np.ndarray) -> None:
        number[rows] += np.bitwise_count(near).sum(axis=1, dtype="i8")
        some = np.flatnonzero(near.any(axis=1))
        at = (near[some] != 0).argmax(axis=1)
        cell = near[some, at]
        lowest = np.bitwise_count((cell & (~cell + np.uint64(1))) - np.uint64(1)).astype("i8")
        first[rows[some]] = at * 64 + lowest

    def blocks(of: np.ndarray):
        for start in range(0, len(of), step):
            yield of[start : start + step]

    for rows in blocks(np.flatnonzero(codes[:, shorter] == 0)):
        letters = codes[rows]
        agreed = np.broadcast_to(short | longer, (len(rows), index.width)).copy()
        replaced = np.zeros_like(agreed)
        more = agreed & longer if head == 0 else np.zeros_like(agreed)  # the word has a letter more, already passed
        settled = None
        for j in range(shorter):
            if j == end:
                settled = agreed.copy()
            here = index.having(j, letters[:, j])
            replaced &= here
            if head <= j < end:
                replaced |= agreed & ~here & short
            more &= index.having(j + 1, letters[:, j])
            agreed &= here
            if head <= j + 1 < end:
                more |= agreed & longer
        if settled is not None:
            more &= ~settled
        note(rows, replaced | more)
    for rows in blocks(np.flatnonzero(codes[:, shorter] != 0)):
        letters = codes[rows]
        agreed = np.broadcast_to(short, (len(rows), index.width)).copy()
        missing = np.zeros_like(agreed)  # the word lacks a letter that was read
        settled = None
        for j in range(shorter + 1):
            if j == end:
                settled = agreed.copy()
            if j:
                missing &= index.having(j - 1, letters[:, j])
            if head <= j < end:
                missing |= agreed
            if j < shorter:
                agreed &= index.having(j, letters[:, j])
        if settled is not None:
            missing &= ~settled
        note(rows, missing)
    return number, first


def near_rows(table: pa.Table) -> pa.Table:
    """The words of one group that have near words in it, with their number and the most frequent (ties: the smallest)."""
    shape = [table.column(c)[0].as_py() for c in ("m", "head", "tail")]
    words, counts = table.column("word").to_pylist(), table.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
    words, counts = [words[k] for k in order], np.array([counts[k] for k in order], "i8")
    number, first = near_in_group(words, counts, *shape)
    some = np.flatnonzero(number)
    best = first[some].tolist()
    return pa.table([pa.array([words[k] for k in some.tolist()], pa.string()), pa.array(number[some]), pa.array([words[k] for k in best], pa.string()), pa.array(counts[best])], schema=NEAR_ARROW)


# --- groups --------------------------------------------------------------------------------------

def _key() -> Column:
    """Words whose pairs meet in one group: the length of the shorter, and the letters at both ends that must be equal."""
    return F.concat_ws(":", "m", "head", "tail", F.substring("word", F.lit(1), F.col("head")), F.right("word", F.col("tail")))


def _halved(words: DataFrame) -> DataFrame:
    """Each group as two: the first difference is in the second half of the open letters, or in the first half."""
    open_letters = F.col("m") - F.col("head") - F.col("tail")
    half = F.floor(open_letters / 2).cast("int")
    parts = F.array(F.struct((F.col("head") + half).alias("head"), "tail"), F.struct("head", (F.col("tail") + open_letters - half).alias("tail")))
    return words.select("word", "n", "m", F.explode(parts).alias("part")).select("word", "n", "m", "part.head", "part.tail")


def _grouped(vocabulary: DataFrame, min_points: int, group_letters: int) -> DataFrame:
    """word, n, m, head, tail, key: every word in the groups in which it can meet a near word; large groups are halved."""
    size = F.length("word")
    words = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"), F.lit(0).alias("head"), F.lit(0).alias("tail")).where(F.col("m") >= min_points)
    ready = []
    while True:
        keyed = words.withColumn("key", _key())
        large = settle(keyed.groupBy("key").agg(F.sum(F.col("m") + 1).alias("letters"), F.first(F.col("m") - F.col("head") - F.col("tail")).alias("open"))
                       .where((F.col("letters") > group_letters) & (F.col("open") > 1)).select("key"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*ready, keyed])
        ready.append(keyed.join(sized(large), "key", "left_anti"))
        words = settle(_halved(keyed.join(sized(large), "key", "left_semi")))


def near_words(vocabulary: DataFrame, min_points: int = MIN_POINTS, group_letters: int = GROUP_LETTERS) -> DataFrame:
    """word, n_near, near, near_n for each word of (word, n) that has words at one edit: their number and the most frequent.

    `vocabulary` holds each word once and is computed already. Groups of one kind are packed into indexes of about
    `group_letters` letters; the bound changes the load only. An empty vocabulary has no rows.
    """
    grouped = settle(_grouped(vocabulary, min_points, group_letters))
    kinds = settle(grouped.groupBy("m", "head", "tail").agg(F.ceil(F.sum(F.col("m") + 1) / group_letters).alias("packs")))
    packs = kinds.agg(F.sum("packs")).first()[0] or 1
    pack = F.concat_ws(":", "m", "head", "tail", F.pmod(F.xxhash64("key"), F.col("packs")))
    placed = grouped.join(sized(kinds), ["m", "head", "tail"]).select(pack.alias("pack"), "word", "n", "m", "head", "tail")
    cores = vocabulary.sparkSession.sparkContext.defaultParallelism
    # A number of tasks by the work, which the few bytes of the words do not show.
    placed = placed.repartition(int(min(packs, max(4 * cores, packs // 8))), "pack")
    found = placed.groupBy("pack").applyInArrow(near_rows, NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.near", (-F.col("best.less")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms. Every form is several times as frequent as its word, so chains are short."""
    reached = settle(links.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = settle(reached.join(onward, "root", "left"))
        reached = step.select("word", F.coalesce("onward", "root").alias("root"))
        if step.where(F.col("onward").isNotNull()).isEmpty():
            return reached


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_count: int = MIN_COUNT,
                      ratio: int = RATIO, group_letters: int = GROUP_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every counted word of the documents.

    The form of a word is its most frequent near word (ties: the smallest) if that is at least `ratio` times as frequent, else
    null; the root ends the chain of forms and is the word itself without one. See `count_words` for nulls, empty texts and
    repeated rows; empty tables have no rows.
    """
    vocabulary = settle(count_words(docs, id_col, text_col, min_points, min_count))
    near = near_words(vocabulary, min_points, group_letters)
    kept = F.col("near_n") >= ratio * F.col("n")
    named = settle(vocabulary.join(near, "word", "left").select(
        "word", F.when(kept, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("near_n")).alias("form_n")))
    ends = roots(named.where(F.col("form").isNotNull()))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
