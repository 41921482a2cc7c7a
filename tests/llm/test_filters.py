"""URL rules, decontamination, licenses, toxicity and language against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from llm_tables import ODD, empty_frame, frame, odd_frame, prose, sentence

from wardlog.llm import decontaminate, language, licenses, toxicity, url_filter

URLS = [None, "", "no scheme", "http://", "http://Example.COM", "https://www.example.com/en/1?x=/en/", "https://example.com/en/", "http://example.com/en",
        "http://a.b.example.net/es/4#t", "http://net/fr/", "ftp://x.com?/en/", "http://notexample.com/en/1", "http://evil.org/x.com/y", "http://ex.com://y/en/",
        "http://sub.www.example.com/en/q", "http://ÄÖ.example.net/fr/é", "http://example.com/EN/", "x://" + "a." * 3000 + "com/" + "p" * 5000, "http://.com/", "http://com/#"]


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), r.action == "block"), default=None)
    return host, path, best and best.name, best.action if best else default


def test_url_rules(spark):
    rng = random.Random(1)
    labels = ["www", "example", "com", "net", "org", "x", "a", ""]
    urls = URLS + ["http://" + ".".join(rng.choices(labels, k=rng.randint(1, 4))) + "/" + "/".join(rng.choices(["en", "es", "fr", "q", ""], k=3)) for _ in range(800)]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)] + [(0, urls[4], None, None), (None, None, None, None)], "page_id int, url string, host string, rule string")
    got = sorted(tuple(r) for r in url_filter.judge_urls(pages).where("page_id is not null").collect())
    want = sorted(((k, *plain_verdict(u, url_filter.DEFAULT_RULES)) for k, u in [*enumerate(urls), (0, urls[4])]))
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]
    assert url_filter.judge_urls(pages.where("false")).count() == 0
    assert url_filter.judge_urls(pages, rules=(), default="block").where("verdict = 'block'").count() == len(urls) + 2


def test_automaton_spans_words():
    rng = random.Random(2)
    globs = [[*rng.choices(b"abc/", k=rng.randint(0, 40)), *([url_filter.ANY] if rng.random() < 0.5 else [])] for _ in range(40)]
    globs += [[url_filter.ANY_LABEL, *g] for g in globs[:20]]
    urls = ["".join(rng.choices("abc/", k=rng.randint(0, 12))).encode() for _ in range(200)] + [bytes(t for t in g if t >= 0) for g in globs]
    got = url_filter.ShiftAnd(globs).match(urls)
    for k, url in enumerate(urls):
        for g, glob in enumerate(globs):
            pattern = b"".join(b".*" if t == url_filter.ANY else b"[^/]*" if t == url_filter.ANY_LABEL else re.escape(bytes([t])) for t in glob)
            assert got[k, g] == bool(re.fullmatch(pattern, url, re.S)), (url, glob)


def plain_hits(text, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, hit, names = word.findall(low(text)), set(), set()
    for item, body in items:
        ws = word.findall(low(body))
        size = min(10, len(ws))
        for s in range(len(ws) - size + 1 if ws else 0):
            for p in range(len(words) - size + 1):
                if words[p:p + size] == ws[s:s + size]:
                    hit |= set(range(p, p + size))
                    names.add(str(item))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_decontamination(spark, block_bytes):
    rng = random.Random(4)
    vocabulary = ["ab", "ba", "Éa", "7", "aab", "b"]
    items = [(k, sentence(rng, n, vocabulary)) for k, n in enumerate((0, 1, 2, 3, 9, 10, 11, 14, 25, 25))] + [(10, None), (11, "  .,;"), (9, items_text := "b b 7 aab ab Éa ba ba ab 7 Éa Éa")]
    items[1] = (1, "rare")
    items[2] = (2, "rare pair")
    texts = [*ODD, *(sentence(rng, 60, vocabulary) for _ in range(25)), "x " + items_text.upper().replace(" ", " - "), "a rare, pair!", items[8][1][:60]]
    docs = frame(spark, texts)
    table = spark.createDataFrame(items, "item_id int, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.benchmark_hits(docs, table, block_bytes=block_bytes).collect()}
    assert got == {k: plain_hits(t, items) for k, t in enumerate(texts)}
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, table, block_bytes=block_bytes).collect()}
    assert kept == {k for k, g in got.items() if not g[1]}
    assert decontaminate.benchmark_hits(docs, table.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.benchmark_hits(empty_frame(spark), table).count() == 0
    assert decontaminate.benchmark_hits(odd_frame(spark), table).count() == len(ODD) + 3


def test_licenses(spark):
    rng = random.Random(5)
    grant = licenses.TEMPLATES["MIT-grant"]
    words = grant.split()
    edited = " ".join([*words[:20], "really", *words[22:]])
    texts = [*ODD, prose(rng), prose(rng) + "\nReleased under the\n  MIT license. " + prose(rng), "all rights RESERVED", prose(rng) + " " + edited + " " + prose(rng),
             "Licensed under the Apache License, Version 2.0.", "the license of the software is under the work", " ".join(words[:30]), "İ " * 4 + "Released under the MIT License."]
    got = {}
    for r in licenses.license_matches(frame(spark, texts), id_col="doc_id").collect():
        got.setdefault(r["doc_id"], []).append(r)
    base = len(ODD)
    assert sorted(got) == [base + 1, base + 2, base + 3, base + 4, base + 7]
    mit = got[base + 1][0]
    assert (mit["license"], mit["coverage"]) == ("MIT", 1.0) and texts[base + 1][mit["start"]:mit["end"]] == "Released under the\n  MIT license"
    near = got[base + 3][0]
    assert near["license"] == "MIT-grant" and 0.95 < near["coverage"] < 1 and texts[base + 3][near["start"]:near["end"]] == edited
    assert [r["license"] for r in got[base + 4]] == ["Apache-2.0"]
    assert texts[base + 7][got[base + 7][0]["start"]:got[base + 7][0]["end"]] == "Released under the MIT License"
    assert licenses.license_matches(empty_frame(spark)).count() == 0
    assert licenses.license_matches(odd_frame(spark)).count() == 0


def test_licenses_close_to_each_other():
    index = licenses.LicenseIndex()
    found = lambda text: [(m[0], text[m[2]:m[3]]) for m in index.matches(text)]
    notice, mit = "All rights reserved", "Released under the MIT License"
    assert found(". ".join([notice] * 5)) == [("Proprietary", notice)] * 5
    assert found(f"{notice}. {notice}.\nby us {notice} {mit}. {mit}\n{notice}") == [("Proprietary", notice)] * 3 + [("MIT", mit)] * 2 + [("Proprietary", notice)]
    grant = licenses.TEMPLATES["BSD-grant"]
    assert found(f"{grant}. {grant}") == [("BSD-grant", grant)] * 2
    # an edit at any word of a five-word template that leaves a shingle whole
    for k in (0, 1, 3, 4):
        words = mit.split()
        words[k] = "xyz"
        assert [(m[0], m[1]) for m in index.matches("text before " + " ".join(words) + " text after")] == [("MIT", 0.8)]


def test_grammar_clauses():
    grammar = toxicity.Grammar()
    weight = lambda text: sum(grammar.clauses(text))
    assert weight("You are an idiot.") > weight("This is an idiot.") > weight("He is not an idiot.") > 0
    assert weight("She said you are an idiot.") < weight("You are an idiot.")
    assert weight("I will kill the process.") == 0 < weight("I will kill you.")
    assert weight("Nobody is stupid.") == toxicity.NEGATED * weight("This is stupid.")
    assert weight("You kill me with jokes.") == 0 < weight("You I will kill.")
    assert weight("they say: idiot") == toxicity.REPORTED * weight("they, the idiot")
    assert grammar.clauses(None) == grammar.clauses("") == grammar.clauses("A clean text.") == []
    assert len(grammar.clauses("idiot. moron! scum")) == 3


def test_threat_with_its_target_on_either_side():
    grammar = toxicity.Grammar()
    weight = lambda text: sum(grammar.clauses(text))
    assert weight("I will kill you.") > 0 and weight("You I will kill.") > 0 and weight("going to hurt one of them") > 0
    assert weight("I will not kill you.") < weight("I will kill you.")
    assert grammar.clauses("I will kill the process.") == grammar.clauses("I will kill. You stay.") == []
    assert grammar.clauses("kill one two three four five you") == []
    assert len(grammar.clauses("kill the process, idiot")) == 1 and weight("kill the process, idiot") == weight("idiot")


def plain_clauses(text, lexicons, stems):
    """The grammar by its definition: every weighted word looks at the words around it."""
    out = []
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words, total = re.findall(r"[^\W\d_]+", clause), 0.0
        for k, word in enumerate(words):
            has = lambda kind, some: any(w in lexicons[kind] for w in some)
            near = words[max(0, k - 4):k] + words[k + 1:k + 5]
            stem = max((s for s in stems if word.startswith(s)), key=len, default=None)
            weight = max(4.0 if word in lexicons["insult"] else 0.0, stems.get(stem, 0.0))
            if not weight and word in lexicons["threat"] and has("target", near) and not has("self", words[k + 1:k + 2]):
                weight = 3.0
            weight *= 0.4 if has("negation", words[max(0, k - 4):k]) else 1
            weight *= 0.6 if has("report", words[:k]) else 1
            total += weight * (1.25 if has("target", near) else 1)
        if total:
            out.append(total)
    return out


def test_composed_machine_equals_plain_grammar():
    rng = random.Random(12)
    # words with several tags, and stems that are beginnings of words with another tag
    lexicons = toxicity.LEXICONS | {"report": toxicity.REPORTS | {"nor", "idiot"}, "target": toxicity.TARGETS | {"trash", "kill"}}
    stems = {"scri": 2.5, "writ": 1.5, "scribe": 0.5}
    grammar = toxicity.Grammar(stems={k: v for k, v in stems.items()}, lexicons=lexicons)
    words = ["idiot", "trash", "kill", "hurt", "you", "they", "not", "nor", "nobody", "says", "wrote", "me", "us", "a", "the", "of", "process", "scribbles", "scribe", "é", "x1y"]
    for _ in range(1500):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", "!"]) for _ in range(rng.randint(0, 40)))
        assert grammar.clauses(text) == pytest.approx(plain_clauses(text, lexicons, stems)), text


def test_composition():
    assert len(toxicity.FORWARD) == (toxicity.REACH + 1) ** 2 * 2 and len(toxicity.BACKWARD) == (toxicity.REACH + 1) * 2
    parts = toxicity.scope(toxicity.NEGATION, 1, 3), toxicity.scope_to_end(toxicity.REPORT, 2), toxicity.scope(toxicity.TARGET, 4, 2)
    rng = random.Random(13)
    for _ in range(100):
        tags = [rng.choice([0, 0, 0, *toxicity.TAGS, 63]) for _ in range(30)]
        one_by_one = [toxicity.read(part, tags) for part in parts]
        assert toxicity.read(toxicity.compose(*parts), tags) == [sum(m) for m in zip(*one_by_one)]


def test_text_without_clause_never_follows_the_base_rate():
    grammar = toxicity.Grammar(coefficients=(2.0, 0.5, 0.0))
    assert grammar.score(grammar.clauses("A clean text.")) == grammar.score(grammar.clauses(None)) < 0.3 < grammar.score(grammar.clauses("you idiot"))


def test_toxicity_learns_stems(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(900):
        text, bad = prose(rng, 4), k % 6 == 0
        if bad:
            words = text.split()
            for _ in range(2):
                words.insert(rng.randrange(len(words)), "zorbel" + rng.choice(["ung", "o", "ix", "ant", "ery", "us"]) if k % 2 else "moron")
            text = " ".join(words)
        texts.append(text)
        labels.append((k, None if k % 97 == 0 else int(bad)))
    docs, table = frame(spark, texts), spark.createDataFrame([*labels, (None, 1), (5000, 1)], "doc_id long, toxic int")
    grammar = toxicity.fit_grammar(docs, table)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, grammar).collect()}
    outside = [k for k in scored if toxicity.held_out(k) == 0]
    assert sum((scored[k] >= 0.5) == (k % 6 == 0) for k in outside) / len(outside) > 0.97
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, grammar).collect()}
    assert kept == {k for k, s in scored.items() if s < 0.5}
    again = spark.createDataFrame([(k, 1 - v if v is not None and toxicity.held_out(k) == 0 else v) for k, v in labels], "doc_id long, toxic int")
    assert toxicity.fit_grammar(docs, again) == grammar  # held-out labels are never read
    assert toxicity.score_documents(odd_frame(spark), grammar).where("score between 0 and 0.5").count() == len(ODD) + 3
    assert toxicity.fit_grammar(empty_frame(spark), table.where("false")) == toxicity.Grammar()
    ids = [(0,), (17,), (123456789,)]
    folds = spark.createDataFrame(ids, "i long").select("i", toxicity.fold_of(F.col("i")).alias("fold")).collect()
    assert all(r["fold"] == toxicity.held_out(r["i"]) for r in folds)


def test_language(spark):
    words = {"en": "the and with that this from there which would their people about", "de": "der die und nicht werden eine auch über schön größe müssen zwischen",
             "es": "los para que una como está pero también año niños entonces donde", "fr": "les des une que pour dans être avec à même où très français"}
    rng = random.Random(7)
    texts = [(k, sentence(rng, 30, words[lang].split()), lang) for k, lang in enumerate(sorted(words) * 40)]
    docs = spark.createDataFrame([*texts, (None, None, None), (999, "x", "xx")], "doc_id long, text string, lang string")
    model = language.fit_text_model(docs)
    pages = [(k, f"http://{lang}.example.org/{k}", f"<html lang='{rng.choice(['en', lang])}'><script>var the = 'and with';</script><p>{sentence(rng, 30, words[lang].split())}</p>", "zz")
             for k, lang in enumerate(sorted(words) * 20)]
    odd = [(1000, None, None, None), (1001, "http://de.example.org/z", "", None), (1002, "http://x.org/fr/1", "<html lang=fr>", None), (1003, "nonsense", "<p" * 5000, None), (None, None, "hola", None), pages[0]]
    table = spark.createDataFrame(pages + odd, "page_id long, url string, html string, lang string")
    got = [(r["page_id"], r["lang"], r["confidence"]) for r in language.identify_pages(table, model).collect()]
    assert len(got) == len(pages) + len(odd) and all(lang in words and 0.24 < sure <= 1.0 for _, lang, sure in got)
    by = dict((k, lang) for k, lang, _ in got)
    assert all(by[k] == sorted(words)[k % 4] for k in range(80)) and by[1001] == "de" and by[1002] == "fr"
    assert language.identify_pages(table.where("false"), model).count() == 0
    assert language.identify_pages(table, language.fit_text_model(docs.where("false"))).count() == len(got)
