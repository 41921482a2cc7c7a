"""Spelling variants, line dedup and tokenizer alignment against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_tables import ODD, empty_frame, frame, odd_frame, prose
from tokenizers import Tokenizer

from wardlog.llm import alignment, lines_once, spelling

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling ------------------------------------------------------------------------------------

def plain_counts(texts, every=199):
    counts = Counter()
    for number, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if w != word and abs(len(w) - len(word)) < 2 and one_edit(w, word)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        out[word] = (best if best and counts[best] >= 5 * n else None, n, len(near))
    found = {}
    for word, (form, n, near) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        found[word] = (form, root, n, near, counts[form] if form else None)
    return found


def misspelt(rng, count):
    """Words around a few stems, so that many are near each other; a letter is often repeated."""
    stems = ["".join(rng.choices("aabcé", k=rng.randint(6, 9))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "ababababa"]
    words = []
    for _ in range(count):
        word = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(word))
            word[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é", "ab"])
        words.append("".join(word))
    return words


@pytest.mark.parametrize("group_letters", [1 << 17, 60])
def test_spelling_variants(spark, group_letters):
    rng = random.Random(5)
    words = misspelt(rng, 9000)
    words += [w for w in words[:40] for _ in range(rng.choice([30, 200]))]
    rng.shuffle(words)
    texts = [" ".join(words[k : k + 60]).replace("a", "A", k % 7) for k in range(0, len(words), 60)] + ODD
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(frame(spark, texts), group_letters=group_letters).collect()}
    want = plain_variants(plain_counts(enumerate(texts)))
    assert got == want and len(want) > 300 and sum(v[0] is not None for v in want.values()) > 30 and any(v[1] != (v[0] or k) for k, v in want.items())


def test_letters_left_out_and_odd_rows(spark):
    texts = ["repeated words standing " * 3, None, ""] * 500
    assert {r["word"]: r["n"] for r in spelling.count_words(frame(spark, texts)).collect()} == plain_counts(enumerate(texts))
    assert set(plain_counts(enumerate(texts))) > {"repeated", "standing"}  # and at least one with a letter left out
    odd = [(r["doc_id"], r["text"]) for r in odd_frame(spark).collect()]
    assert {r["word"]: r["n"] for r in spelling.spelling_variants(odd_frame(spark)).collect()} == plain_counts(odd)
    assert spelling.spelling_variants(empty_frame(spark)).count() == 0


def test_every_pair_is_counted_once_however_groups_are_cut():
    rng = random.Random(8)
    words = sorted({w for w in misspelt(rng, 500) if len(w) in (6, 7)})
    counts = np.array([rng.randint(1, 9) for _ in words])
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
    words, counts = [words[k] for k in order], counts[order]
    number, first = spelling.near_in_group(words, counts, 6, 0, 0)
    near = [[v for v, other in enumerate(words) if v != w and 6 in (len(other), len(word)) and one_edit(word, other)] for w, word in enumerate(words)]
    assert number.tolist() == [len(x) for x in near] and first.tolist() == [min(x, default=-1) for x in near]
    parts = sum(spelling.near_in_group(words, counts, 6, head, tail)[0] for head, tail in [(0, 4), (2, 3), (3, 0)])
    assert parts.tolist() == number.tolist()


# --- lines ---------------------------------------------------------------------------------------

def plain_lines(rows):
    blanks = " \t\n\x0b\x0c\r"
    holders = {}
    for number, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(blanks).translate(A_TO_Z), set()).add((number is None, number or 0))
    out = []
    for number, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(blanks).translate(A_TO_Z)) < 10 or (number is None, number or 0) == min(holders[k])]
        out.append((number, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"max_bits": 1 << 16, "hot_docs": 3}])
def test_line_dedup(spark, settings):
    rng = random.Random(4)
    pool = [prose(rng, 1) for _ in range(60)] + ["short", "漢字かな漢字かな漢字", "漢字かな漢字かな漢", "\x85Ünïcode line Ü"]
    lines = lambda: [rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str, str.title])(rng.choice(pool)) + rng.choice(["", " \r", "\x0b"]) for _ in range(rng.randint(0, 12))]
    texts = ["\n".join(lines()) for _ in range(120)] + ODD
    rows = [(k, t, "en", "s", 1, 2, 3, "z") for k, t in enumerate(texts)]
    rows += [(5, pool[0] + "\n" + pool[1], *[None] * 6), (None, pool[2] + "\nonly here, without an id", *[None] * 6), (None, "only here, without an id", *[None] * 6), (None, None, *[None] * 6), rows[7]]
    docs = spark.createDataFrame(rows, frame(spark, []).schema).repartition(5)
    got = sorted((tuple(r) for r in lines_once.dedup_lines(docs, **settings).collect()), key=str)
    assert got == plain_lines([(r[0], r[1]) for r in rows]) and sum(r[3] for r in got) > 300
    assert lines_once.dedup_lines(empty_frame(spark)).count() == 0


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (4000, 2)).astype(np.uint64)
    parts = [keys[:1500], keys[1000:2500], np.concatenate((keys[2600:], keys[3900:]))]
    bits = lines_once.filter_bits(sum(map(len, parts)))
    tasks = []
    for part in parts:
        filters = lines_once.SeenTwice(bits)
        for piece in np.array_split(part, 7):
            filters.add(piece)
        tasks.append(list(filters.segments()))
    twice = np.zeros(bits // 8, np.uint8)
    for number in {s[0] for t in tasks for s in t}:
        step = min(lines_once.SEGMENT_BITS, bits) // 8
        raw = lines_once.merged_twice((once, second) for t in tasks for n, once, second in t if n == number)
        twice[number * step : (number + 1) * step] = np.frombuffer(zlib.decompress(raw), np.uint8)
    suspected = lines_once.SeenTwice.has(twice, lines_once.SeenTwice.places(keys, bits))
    repeated = np.zeros(4000, bool)
    repeated[1000:1500] = repeated[3900:] = True
    assert suspected[repeated].all() and suspected[~repeated].mean() < 0.05


# --- alignment -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as one, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as two:
        return one.read(), two.read()


def plain_alignment(files, texts):
    """Groups and links of every text by looking at all pairs of tokens of a text."""
    first = Tokenizer.from_str(files[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    letters = alignment.byte_letters()
    found, counts = [], Counter()
    for text in texts:
        raw = f" {text or ''}".encode()
        a, b = first.encode(f" {text or ''}", add_special_tokens=False).ids, second.encode(text or "")
        bytes_a = [bytes(letters[c] for c in first.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            found.append(([], [], [], []))
            continue
        spans = []
        for tokens in (bytes_a, bytes_b):
            ends = np.cumsum([len(t) for t in tokens]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for low, high in zip([0, *cuts[:-1]], cuts):
            groups.append(tuple([k for k, (s, e) in zip(ids, span) if low <= s and e <= high] for ids, span in zip((a, b), spans)))
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (p, q) in zip(b, spans[1]) if s < q and p < e]
        counts.update(links)
        found.append((a, b, groups, links))
    top = Counter()
    for (x, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


@pytest.mark.parametrize("table_links", [1 << 21, 40, 0])
def test_alignment(spark, files, table_links):
    rng = random.Random(6)
    noise = ["".join(rng.choice("aab 'stréßñ漢🙂\n\t 19.,!ﬁ") for _ in range(rng.randint(1, 120))) for _ in range(40)]
    texts = [*(t for t in ODD if len(t or "") < 1000), *noise, *(prose(rng, 3) for _ in range(25)), "<|endoftext|> <s> <unk> <0x41>", "▁", "a▁b", "  two  blanks ", " ", "    ", "ends in a blank ", "x" * 700]
    got = {r[0]: tuple(r)[1:] for r in alignment.aligned_links(frame(spark, texts).repartition(3), *files, table_links=table_links).collect()}
    want = dict(enumerate(plain_alignment(files, texts)))
    assert got == want and sum(v[0] > 0 for v in want.values()) > 50 and any(v[0] == 0 for k, v in want.items() if texts[k])


def test_alignment_of_odd_rows(spark, files):
    docs = odd_frame(spark)
    assert alignment.aligned_links(docs, *files).count() == docs.count()
    assert alignment.aligned_links(empty_frame(spark), *files).count() == 0
    groups = alignment.align_documents(frame(spark, ["one two", None]), *files).select("groups").collect()
    assert re.fullmatch(r"[\d,]+\|[\d,]+(;[\d,]+\|[\d,]+)*", groups[0][0]) and groups[1][0] == ""


def test_word_by_word_ids_are_those_of_the_whole_text(files):
    """Texts of the characters that take the memo, cut in every odd way; and the memo starting anew."""
    rng = random.Random(7)
    aligner = alignment.Aligner(*files)
    texts = ["".join(rng.choice(["a", "the", "'s", "'re", " ", "  ", "\n", "\t", "1", "42", ".", "!?", "é", "Ü", "ß", "ing", "…", "“", "_", "<s>"]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    assert aligner.by_word and all(alignment.PLAIN.fullmatch(t) for t in texts)
    for memo in (10, 10**6):
        alignment.MEMO_WORDS, before = memo, alignment.MEMO_WORDS
        try:
            got = [aligner.encode(texts[k : k + 100]) for k in range(0, len(texts), 100)]
        finally:
            alignment.MEMO_WORDS = before
        for text, a, b in zip(texts, (x for g in got for x in g[0]), (x for g in got for x in g[1]), strict=True):
            assert a.tolist() == aligner.first.encode(" " + text, add_special_tokens=False).ids and b.tolist() == aligner.second.encode(text), text


def test_pointers_reach_the_last_token_of_a_chain():
    """Tokens of two letters that overlap like bricks: one component, whatever its length."""
    count = 5000
    ends_a, ends_b = np.arange(1, count + 1) * 2, np.append(np.arange(count) * 2 + 1, 2 * count)
    last = alignment.terminals(ends_a - 2, ends_a, np.concatenate(([0], ends_b[:-1])), ends_b)
    assert (last == count).all()
