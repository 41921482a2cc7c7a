"""Fingerprints, near-duplicates and substring dedup against brute force."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_tables import ODD, SCHEMA, empty_frame, frame, odd_frame, prose, rows

from wardlog.llm import minhash, simhash, substrings


def plain_simhash(text):
    data = (text or "").encode()
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    grams = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    """values: (id, fingerprint); smallest id reachable over at most 2 differing bits."""
    label = dict(values)
    out = {i: i for i, _ in values}
    changed = True
    while changed:
        changed = False
        for i, a in values:
            for j, b in values:
                if bin(a ^ b).count("1") <= 2 and out[j] < out[i]:
                    out[i], changed = out[j], True
    assert label
    return out


def test_fingerprint_matches_plain():
    rng = random.Random(1)
    for text in [*ODD, *(prose(rng, 3) for _ in range(30))]:
        assert simhash.fingerprint(text) == plain_simhash(text)


@pytest.mark.parametrize("hot", [2, 4096])
def test_links_and_components(spark, hot):
    rng = random.Random(2)
    values = []
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(25):
            for _ in range(rng.randint(0, 3)):
                center ^= 1 << rng.randrange(64)
            values.append(center)
    values += [rng.getrandbits(64) for _ in range(50)] + [0, 3, 1 << 63]
    values = list(dict.fromkeys(values))
    rng.shuffle(values)
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(values)], "fp long, name long").repartition(3)
    found = {r["node"]: r["label"] for r in simhash.components(simhash.fingerprint_links(table, hot)).collect()}
    want = plain_components(list(enumerate(values)))
    assert {k: found.get(k, k) for k in want} == want


def test_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8))]))
    groups = rng.integers(0, 3, len(values))
    order = np.lexsort((simhash.gray_rank(values), groups))
    values, groups = values[order], groups[order]
    got = {(i, j) for left, right in simhash.GrayIndex(groups, values).pairs(2) for i, j in zip(left.tolist(), right.tolist())}
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if groups[i] == groups[j] and bin(int(values[i] ^ values[j])).count("1") <= 2}


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [prose(rng) for _ in range(6)]
    texts = [*base, *base[:3], *(b.replace(" ", "  ", 3) for b in base), *(b + " end" for b in base), *ODD]
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = [(k, plain_simhash(t)) for k, t in enumerate(texts)]
    labels = plain_components(prints)
    assert got == {k: (v - (1 << 64) if v >> 63 else v, labels[k]) for k, v in prints}
    kept = simhash.keep_one(frame(spark, texts).union(frame(spark, texts[:2])))
    assert kept.columns == frame(spark, texts).columns and kept.count() == len(set(labels.values()))
    assert simhash.near_duplicates(odd_frame(spark)).count() == len(ODD) + 3
    assert simhash.near_duplicates(empty_frame(spark)).count() == simhash.keep_one(empty_frame(spark)).count() == 0


def test_rows_without_id_link_like_others(spark):
    """A row without id one edit away from a row with one, and between two of them; rows without id among themselves."""
    rng = random.Random(14)
    base = [prose(rng, 30) for _ in range(8)]
    texts = [(k if k < 5 else None, b + end) for k, b in enumerate(base) for end in ("", " end", " end of it", " and more")]
    texts = [(None if k % 4 else i, t) for k, (i, t) in enumerate(texts)] + [(100 + k, b + " end of it all") for k, b in enumerate(base[:2])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(((r["fp"] % (1 << 64), r["doc_id"] is None, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [plain_simhash(t) for _, t in texts]
    label = plain_components(list(enumerate(prints)))
    smallest = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            smallest[label[k]] = min(i, smallest.get(label[k], i))
    want = [(prints[k], i is None, smallest.get(label[k])) for k, (i, _) in enumerate(texts)]
    assert got == sorted(want, key=str) and sum(n and c is not None for _, n, c in want) > 3 and sum(c is None for _, _, c in want) > 3


def plain_sketch(text):
    """The fingerprint by its definition, in plain Python."""
    def long_hash(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed)
        return seed - (1 << 64) if seed >> 63 else seed

    pack = lambda v: (v % (1 << 64)).to_bytes(8, "little")
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    h = [long_hash([w.encode()]) for w in words]
    grams = [h[k:k + 5] for k in range(max(1, len(h) - 4))] if h else []
    bins = [None] * 256
    for g in grams:
        v = long_hash([pack(x) for x in g])
        if v & minhash.LOW != minhash.LOW:
            b = (v >> 56) + 128
            bins[b] = v if bins[b] is None else min(v, bins[b])
    if not grams:
        return ""
    full = []
    for i in range(256):
        donors = [long_hash([i.to_bytes(4, "little"), t.to_bytes(4, "little")]) % 256 for t in range(1, 9)]
        choice = [bins[i], *(bins[d] for d in donors), min(((long_hash([i.to_bytes(4, "little"), (0).to_bytes(4, "little"), pack(v >> 56)]), v) for v in bins if v is not None))[1]]
        full.append(next(v for v in choice if v is not None) & 255)
    return bytes(full).hex()


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    return max(0.0, (sum(p == q for p, q in zip(x, y)) / 256 - 1 / 256) / (255 / 256))


def test_edited_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 5)
    rng = random.Random(5)
    texts = [*(t for t in ODD if t is None or len(t) < 7000), *(prose(rng, rng.randint(1, 30)) for _ in range(20)), "a tail of five words ends"]
    table = [(k * 3 if k % 2 else k * 3 - 7, t) for k, t in enumerate(texts)] + [(9, "repeated id, a"), (9, "repeated id, b"), (None, "no id"), (None, None)]
    got = minhash.edited_fingerprints(spark.createDataFrame([(i, t, "c", 1) for i, t in table], "doc_id int, text string, fingerprint string, _b int").repartition(4)).collect()
    order = sorted(((i is not None, i or 0, t or ""), i, t or "") for i, t in table)
    want = []
    for k, (_, i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b = plain_sketch(text), plain_sketch(edited)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, plain_sketch(following))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert minhash.edited_fingerprints(empty_frame(spark)).count() == 0
    alone = minhash.edited_fingerprints(frame(spark, ["one two three four five six"])).first()
    assert alone["near_next"] == 1.0


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    pairs = []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0) * 4:
        a = rng.sample(words, 800)
        cut = int(800 * share)
        pairs.append((" ".join(a), " ".join(a[:cut] + rng.sample(words, 800 - cut))))
    shingles = lambda t: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)}
    table = spark.createDataFrame(pairs, "a string, b string").select("a", "b", minhash.likeness(minhash.sketch(F.col("a")), minhash.sketch(F.col("b"))).alias("s"))
    errors = [r["s"] - len(shingles(r["a"]) & shingles(r["b"])) / len(shingles(r["a"]) | shingles(r["b"])) for r in table.collect()]
    assert max(map(abs, errors)) < 0.13 and abs(sum(errors) / len(errors)) < 0.03


def plain_units(text):
    """{place: key} by the words themselves, window places by plain integers: whole lines, and of any STEP windows the smallest."""
    lines = [line.split() for line in text.lower().split("\n")]
    words, out, starts = [w for line in lines for w in line], {}, []
    for line in lines:
        starts.append(sum(map(len, lines[:len(starts)])))
        if len(line) >= substrings.LINE_WORDS:
            out[starts[-1], len(line), "line"] = tuple(line)
    size, values = substrings.WINDOW, []
    for k in range(len(words) - size + 1):
        value = 0
        for w in words[k:k + size]:
            value = (value * 0x9E3779B97F4A7C15 + (xxhash.xxh3_128_intdigest(w.encode("utf-8", "surrogatepass")) & (1 << 64) - 1)) % (1 << 64)
        values.append(value ^ value >> 32)
    places = {k for k in starts if k < len(values)}
    for k in range(max(1, len(values) - substrings.STEP + 1)):
        near = values[k:k + substrings.STEP]
        places |= {k + j for j, v in enumerate(near) if v == min(near)}
    return out | {(k, size, "part"): tuple(words[k:k + size]) for k in places}


def plain_cut(table, min_words=substrings.MIN_WORDS, unit="passage"):
    """table: (id, text) in rank order; the words that stay of each text, one at a time, without digests or groups."""
    seen, out = set(), {}
    for name, text in table:
        words = (text or "").split()
        gone = [False] * (len(words) + 1)
        for (first, size, kind), key in sorted(plain_units(text or "").items()):
            if unit == "line" and kind == "part":
                continue
            if (kind, key) in seen:
                gone[first:first + size] = [True] * size
            seen.add((kind, key))
        run = 0
        for k, g in enumerate(gone):
            if not g and 0 < run < min_words:
                gone[k - run:k] = [False] * run
            run = run + 1 if g else 0
        out[name] = [w for w, g in zip(words, gone) if not g]
    return out


def repeated_runs(table, least):
    """(id, first, end): runs of `least` words and more that an earlier text holds, grown word by word."""
    out, earlier = [], {}
    for name, text in table:
        words = (text or "").lower().split()
        k = 0
        while k + least <= len(words):
            best = 0
            for other, at in earlier.get(tuple(words[k:k + least]), []):
                size = least
                while k + size < len(words) and at + size < len(other) and other[at + size] == words[k + size]:
                    size += 1
                best = max(best, size)
            if best:
                out.append((name, k, k + best))
            k += max(1, best - least + 1) if best else 1
        for k in range(len(words) - least + 1):
            earlier.setdefault(tuple(words[k:k + least]), []).append((words, k))
    return out


def pasted_texts(rng):
    """Texts with passages of 51 to 80 words: on own lines, within a line, within a sentence, without any punctuation, with other line breaks."""
    passages = [prose(rng, 7, 8, 10) for _ in range(3)]
    passages += [re.sub(r"[.]", "", prose(rng, 7, 8, 10)).lower() for _ in range(3)]
    texts = []
    for k in range(80):
        own = [prose(rng, rng.randint(1, 6)) for _ in range(3)]
        if k % 2:
            p = rng.choice(passages)
            style = k // 2 % 4
            if style == 3:
                p = "".join("\n" if c == " " and rng.random() < 0.1 else c for c in p)
            own[1] = own[1] + "\n" + p if style == 0 else own[1] + " " + p + " tail words" if style == 1 else own[1][:-1] + " " + p.rstrip(".") + " and so on."
        texts.append("\n".join(own))
    return texts


@pytest.mark.parametrize("unit", ["passage", "line"])
def test_cut_repeats(spark, unit, monkeypatch):
    monkeypatch.setattr("wardlog.llm.substrings.COMBINED", 300)
    rng = random.Random(8)
    texts = pasted_texts(rng)
    texts += [texts[3], texts[5], *ODD]
    docs = frame(spark, texts).repartition(5)
    got = {r["doc_id"]: r for r in substrings.cut_repeats(docs, unit=unit).collect()}
    assert {k: (r["text"] or "").split() for k, r in got.items()} == plain_cut(list(enumerate(texts)), unit=unit)
    for k, r in got.items():
        assert "".join(texts[k][s["start"]:s["end"]] for s in r["kept"]) == (r["text"] or "") and r["lang"] == "en"
        assert (r["text"] is None) == (texts[k] is None)
        spans = sorted((s["start"], s["end"]) for s in [*r["kept"], *r["removed"]])
        assert [b for _, b in spans[:-1]] == [a for a, _ in spans[1:]]
        assert r["removed"] or r["text"] == texts[k]
    if unit == "passage":
        assert all(got[k]["text"] == texts[k] for k in range(0, 80, 2))
    assert substrings.cut_repeats(odd_frame(spark)).count() == len(ODD) + 3
    assert substrings.cut_repeats(empty_frame(spark), spans=False).columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert rows([]) == []


def test_long_passages_go(spark):
    """All but STEP - 1 words at each end of every passage of 51 words and more that an earlier text holds, found word by word."""
    texts = pasted_texts(random.Random(9))
    got = {r["doc_id"]: r["removed"] for r in substrings.cut_repeats(frame(spark, texts).repartition(3)).collect()}
    runs = repeated_runs(list(enumerate(texts)), 51)
    assert len(runs) > 25
    for name, first, end in runs:
        spans = [m.span() for m in re.finditer(r"\S+", texts[name])][first + substrings.STEP - 1:end - substrings.STEP + 1]
        assert all(any(c["start"] <= a and b <= c["end"] for c in got[name]) for a, b in spans)


def test_line_breaks_and_clashes(spark):
    rng = random.Random(10)
    p = prose(rng, 6, 10, 12)
    texts = [p, f"own words\n{p}\nnext line", f"mine here {p}\nthen more", f"first {p} last"]
    got = {r["doc_id"]: r["text"] for r in substrings.cut_repeats(frame(spark, texts)).collect()}
    assert got[1] == "own words\nnext line"
    assert got[2].endswith("\nthen more") and got[2].startswith("mine here ") and len(got[2].split()) <= 4 + 2 * (substrings.STEP - 1)
    assert got[3].startswith("first ") and got[3].endswith(" last")
    with pytest.raises(ValueError):
        substrings.cut_repeats(frame(spark, texts).withColumn("kept", F.lit(1)))
    # The same row twice is one document; the same text under another id is a repeat.
    twice = frame(spark, [p]).union(frame(spark, [p])).union(frame(spark, [p], 1))
    assert sorted((r["doc_id"], r["text"]) for r in substrings.cut_repeats(twice).collect()) == [(0, p), (0, p), (1, "")]


def test_common_passage_arrives_once_a_task():
    """A task sends one row a digest to the ranking, however many of its texts hold it; all other places are known repeats."""
    rng = random.Random(11)
    p = prose(rng, 6, 10, 12)
    for n in (40, 400):
        words, block = substrings.Words(), substrings.Combined()
        for k in range(n):
            block.add(k if k % 3 else None, k, *substrings.digests(f"{k} {p}", words))
        sent = block.rows().to_pandas()
        ranked = sent[~sent["known"]]
        assert not ranked.duplicated(["key1", "key2"]).any()
        common = substrings.digests(p, words)[0].view(np.int64)
        first = ranked.merge(pd.DataFrame(common, columns=["key1", "key2"]), on=["key1", "key2"])
        # Not there: the whole line, and the window that only the start of the line chooses.
        assert len(common) - 2 <= len(first) < len(common) and set(first["_id"]) == {1}


def copy_families(rng):
    """Families of texts whose members change few words, and texts that share no more than a common opening."""
    texts, family = [], []
    for number in range(6):
        base = prose(rng, 14).split()
        for _ in range(5):
            words = list(base)
            for _ in range(2):
                words[rng.randrange(len(words))] = "changed%d" % rng.randrange(10**6)
            texts.append(" ".join(words))
            family.append(number)
    opening = prose(rng, 2)
    return texts + [opening + " " + prose(rng, 14) for _ in range(12)], family + list(range(100, 112))


@pytest.mark.parametrize("hot,piece", [(4096, 1 << 16), (2, 1 << 16), (4096, 8)])
def test_near_copies(spark, monkeypatch, hot, piece):
    """Against Jaccard similarity of five-word shingles by brute force: every pair at 0.85 or more, none below 0.6."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    texts, family = copy_families(random.Random(11))
    texts += [texts[0].upper(), "  " + texts[5].replace(" ", "\n")]
    family += [family[0], family[5]]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame(spark, texts).repartition(3), hot=hot).collect()}
    shingles = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    for a in range(len(texts)):
        for b in range(a):
            alike = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
            if alike >= 0.85:
                assert got[a] == got[b]
            if family[a] != family[b]:
                assert alike < 0.6 and got[a] != got[b]
    kept = simhash.keep_one(frame(spark, texts), groups=simhash.near_copies(frame(spark, texts), hot=hot))
    assert kept.count() == len(set(got.values()))


def test_near_copies_of_odd_rows(spark):
    odd = simhash.near_copies(odd_frame(spark)).collect()
    assert len(odd) == len(ODD) + 1  # rows without id are not grouped
    by_id = {r["doc_id"]: r["component_id"] for r in odd}
    assert by_id[0] == by_id[1] == by_id[2] == by_id[3] == 0 and by_id[16] == by_id[15] == 15
    assert simhash.near_copies(empty_frame(spark)).count() == 0


def test_classes_of_a_large_group():
    """Thousands of members of one family and some others in one group: the classes of brute force."""
    rng = np.random.default_rng(5)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(3000)])
    values = np.unique(np.concatenate([np.uint64(0x0123456789ABCDEF) ^ flips, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    values = values[np.argsort(simhash.gray_rank(values))]
    label = simhash.GrayIndex(np.zeros(len(values), np.int64), values).classes(6, lambda i, j: np.ones(len(i), bool))
    far = np.bitwise_count(values[:, None] ^ values[None, :]) > 6
    plain = np.arange(len(values))
    left, right = np.nonzero(~far)
    assert (label == simhash.joined(plain, left, right)).all()


@pytest.mark.parametrize("piece", [1 << 16, 64])
def test_links_carry_the_names_of_their_members(piece):
    """Names in no order of the prints: every link joins two members of one family."""
    rng = np.random.default_rng(9)
    family = rng.integers(0, 40, 400)
    centers = rng.integers(0, 1 << 63, (40, simhash.WIDE), dtype=np.uint64)
    wide = centers[family] ^ (np.uint64(1) << rng.integers(0, 64, (400, simhash.WIDE)).astype(np.uint64))
    key = np.sort(rng.integers(0, 3, 400))
    name = rng.permutation(400)
    of = dict(zip(name.tolist(), family.tolist()))
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(400, -1)), pa.array(name), pa.array([w.tobytes() for w in wide])], names=["key", "sub", "name", "wide"])
    links = [(a, b) for out in simhash._near_links_in_partition(0.8, piece)(iter([batch.slice(k, 32) for k in range(0, 400, 32)])) for a, b in zip(out[0].to_pylist(), out[1].to_pylist())]
    groups = len(set(zip(key.tolist(), family.tolist())))
    assert all(of[a] == of[b] for a, b in links) and len({a for a, _ in links}) == 400 - groups


def near_the_bound(rng, pairs):
    """Pairs of texts whose last words differ, with Jaccard similarities from about 0.7 to 0.9, many of them next to 0.8."""
    texts = []
    for k in range(pairs):
        words = ["w%d" % rng.randrange(10**6) for _ in range(94)]
        changed = 10 + (k % 3 - 1) * (1 if k % 2 else rng.randint(1, 5))
        texts += [" ".join(words), " ".join(words[:94 - changed] + ["x%d" % rng.randrange(10**6) for _ in range(changed)])]
    return texts


def plain_copies(texts, num=4, den=5):
    """Smallest id reachable over pairs with a Jaccard similarity of num / den or more, and the number of pairs just below and at it."""
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    label, links = np.arange(len(texts)), []
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            shared = len(sets[a] & sets[b])
            if shared * den >= num * (len(sets[a]) + len(sets[b]) - shared):
                links.append((a, b))
    left, right = np.array(links, int).reshape(-1, 2).T
    return simhash.joined(label, left, right).tolist()


def test_near_copies_at_the_bound(spark):
    """0.8 links, anything less does not."""
    texts = near_the_bound(random.Random(21), 60)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame(spark, texts).repartition(3)).collect()}
    want = plain_copies(texts)
    assert len(set(want)) not in (60, 120) and [got[k] for k in range(len(texts))] == want


@pytest.mark.parametrize("hot", [2, 4096])
def test_hot_keys_lose_no_pair(spark, monkeypatch, hot):
    """Keys far over `hot` and groups far over PIECE: every pair at 0.8 or more meets, whatever the size."""
    monkeypatch.setattr(simhash, "PIECE", 8)
    texts = copy_families(random.Random(22))[0][:20] + near_the_bound(random.Random(23), 10)
    labels = simhash.settle(spark.createDataFrame([(k, k) for k in range(len(texts))], "name long, label long"))
    table = frame(spark, texts).select("doc_id", F.col("text").alias("_text"))
    found = simhash.settle(simhash.meetings(table, labels, Fraction(4, 5), 5, hot))
    led = {}
    for r in found.collect():
        led.setdefault(r["leader"], set()).add(r["name"])
    got = {(a, b) for members in led.values() for a in members for b in members if a < b}
    sure = np.array([(r["a"], r["b"]) for r in simhash.linked(found, table, Fraction(4, 5), 5, hot).collect()]).T
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    left, right = np.array(sorted(want)).T
    assert len(want) > 20 and want <= got
    assert (simhash.joined(np.arange(len(texts)), *sure) == simhash.joined(np.arange(len(texts)), left, right)).all()


def edited_family(rng, members, edits):
    """Members that differ from one text of 150 words in a few words each."""
    base = ["w%d" % rng.randrange(10**6) for _ in range(150)]
    out = []
    for _ in range(members):
        words = list(base)
        for _ in range(rng.choice(edits)):
            words[rng.randrange(150)] = "x%d" % rng.randrange(10**6)
        out.append(" ".join(words))
    return out


def test_families_give_rows_by_members_not_by_pairs(spark):
    """A family of mostly 0.65 to 0.79 and one of mostly over 0.8: links as by brute force, rows in proportion to members."""
    rng = random.Random(31)
    texts = edited_family(rng, 400, [2, 3]) + edited_family(rng, 120, [1, 2])
    labels = simhash.settle(spark.createDataFrame([(k, k) for k in range(len(texts))], "name long, label long"))
    table = frame(spark, texts).select("doc_id", F.col("text").alias("_text"))
    found = simhash.settle(simhash.meetings(table, labels, Fraction(4, 5), 5))
    links = simhash.linked(found, table, Fraction(4, 5), 5, 150)
    assert found.count() < 40 * len(texts) and links.count() < 20 * len(texts)
    left, right = np.array([(r["a"], r["b"]) for r in links.collect()]).T
    want = plain_copies(texts)
    assert simhash.joined(np.arange(len(texts)), left, right).tolist() == want and 20 < len(set(want)) < 450
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_classes_alike_at_the_bound():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.choice(1 << 40, 60, replace=False).astype(np.uint64)
        sets = [np.sort(np.unique(np.concatenate((rng.choice(base, rng.integers(45, 60), replace=False), rng.choice(1 << 40, rng.integers(0, 4)).astype(np.uint64))))) for _ in range(14)]
        labels = rng.integers(0, 12, 14)
        links = [(a, b) for a in range(14) for b in range(a + 1, 14) if labels[a] == labels[b] or 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
        left, right = np.array(links, int).reshape(-1, 2).T
        assert (simhash.classes_alike(labels, sets, 4, 5) == simhash.joined(np.arange(14), left, right)).all()


def test_clean_rows_stay(spark):
    """Texts that were blank before the cut, and rows that repeat an id with another text."""
    import corpus_pipeline

    passage = " ".join("w%d" % k for k in range(60))
    table = spark.createDataFrame([(1, passage, 0), (2, passage, 0), (3, "", 0), (4, "  ", 0), (5, None, 0)], "doc_id long, text string, n_chars long")
    left = corpus_pipeline.cut_repeated_passages(spark, table, "")
    assert left.columns == table.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5]
    rows_of = spark.createDataFrame([(7, "one text"), (7, "another text"), (7, "one text"), (8, None), (8, None)], "doc_id long, text string")
    groups = spark.createDataFrame([(7, 7), (8, 8)], "doc_id long, component_id long")
    kept = simhash.keep_one(rows_of, groups=groups).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(7, "another text"), (7, "one text"), (8, "")]
