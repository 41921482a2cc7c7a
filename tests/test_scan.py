import random

import pytest
from pyspark.sql import functions as F

from wardlog.operators import literals
from wardlog.operators.normalize import normalize
from wardlog.operators.predicates import direct_probe, matching, selection_holds, staged_probe
from wardlog.operators.rules import load_rules, rule_from
from wardlog.operators.scan import in_scan_order, scan

PACK, _ = load_rules()
FIELDS = {"date": "2025-11-19", "time": "23:04:59", "c-ip": "198.51.100.77", "cs-method": "PUT", "cs-uri-stem": "/Depot/Panel.ashx",
          "cs-uri-query": "run=IPCONFIG&n=3", "sc-status": "206", "cs(User-Agent)": "fetcher (nightly)", "s-port": "8443", "x-note": "7b"}


def raw(spark, *fields):
    return normalize(spark.createDataFrame([("t.log", i + 1, "raw", f) for i, f in enumerate(fields)],
                                           "log_file string, line_number bigint, raw_line string, fields map<string,string>"))


@pytest.fixture(scope="module")
def record(spark):
    return raw(spark, FIELDS).persist()


# Per operator: equality (case counts, lists, numbers, flags), substrings and ends (no case), patterns, sets, presence, bounds.
CASES = [
    ("host", "x", False), ("method", "PUT", True), ("method", "put", True), ("method", "pu", False), ("status", 206, True), ("status", [500, 206], True), ("status", [], False),
    ("is_success_status", True, True), ("is_success_status", False, False),
    ("user_agent|contains", "NIGHT", True), ("user_agent|contains", "day", False), ("user_agent|contains", "", True), ("host|contains", "x", False),
    ("uri_query_decoded|contains_any", ["ipconfig", "zzz"], True), ("uri_query_decoded|contains_any", ["zzz", "yyy"], False),
    ("uri_path|startswith", "/depot", True), ("uri_path|startswith", "depot", False), ("status|startswith", "20", True),
    ("uri_path|startswith_any", ["/a", "/b"], False), ("uri_path|startswith_any", ["/DEPOT/", "/b"], True), ("timestamp|startswith", "2025-11-19T23:04", True),
    ("uri_path|endswith", "panel.ASHX", True), ("uri_path|endswith", ".ash", False), ("uri_path|endswith_any", [".jsp", ".ashx"], True),
    ("uri_query|re", r"n=\d$", True), ("uri_query|re", r"^n=", False), ("uri_query|re", ["^zz", "(?P<word>run)=ipconfig"], True),
    ("method|in", ["DELETE", "PUT"], True), ("method|in", ["put"], True), ("method|in", ["pu", "DELETE"], False),
    ("src_ip|exists", True, True), ("referer|exists", True, False), ("nowhere|not_exists", True, True), ("src_ip|not_exists", True, False),
    ("status", {"gt": 206}, False), ("status", {"gte": 206, "lte": 206}, True), ("status", {"lt": 300, "gt": 100.5}, True), ("status", {}, True),
    ("nowhere", {}, False), ("s-port", {"lt": 9000}, True), ("x-note", {"lt": 10 ** 9}, False),
]


def test_operators(record):
    """Every case both ways: straight and through the shared helper columns."""
    tests = [rule_from({"id": "r", "title": "r", "level": "low", "detection": {"selection": {k: v}}}).branches[0].required[0]
             for k, v, _ in CASES]
    staged, probe = staged_probe(record, [t for s in tests for t in s])
    for frame, how in ((record, direct_probe(record)), (staged, probe)):
        row = frame.select(*[selection_holds(s, how).alias(f"c{i}") for i, s in enumerate(tests)]).first()
        assert [(CASES[i][:2], got) for i, got in enumerate(row)] == [(c[:2], c[2]) for c in CASES]


YES, ALSO, NO = {"method": "PUT"}, {"uri_path|contains": "panel", "status": 206}, {"src_ip|startswith": "10."}


@pytest.mark.parametrize("detection,hit,fields", [
    ({"selection": ALSO}, True, ["uri_path", "status"]),
    ({"only": ALSO, "condition": "only"}, True, ["uri_path", "status"]),
    ({"l": YES, "r": ALSO, "condition": "l AND r"}, True, ["method", "uri_path", "status"]),
    ({"l": YES, "r": NO, "condition": "l and r"}, False, None),
    ({"l": NO, "r": ALSO, "condition": "l or r"}, True, ["uri_path", "status"]),
    ({"l": YES, "r": ALSO, "condition": "l or r"}, True, ["method"]),
    ({"l": NO, "r": NO, "condition": "l Or r"}, False, None),
    ({"l": YES, "r": NO, "condition": "l and not r"}, True, ["method"]),
    ({"l": YES, "r": ALSO, "condition": "l and not r"}, False, None),
    ({"s": {"host|not_exists": True, "user_agent|endswith": ")"}, "condition": "s"}, True, ["user_agent"]),
])
def test_conditions_and_evidence(record, detection, hit, fields):
    rule = rule_from({"id": "r", "title": "r", "level": "low", "detection": detection})
    found = scan(record, [rule]).collect()
    assert len(found) == hit == matching(record, rule).count()
    if hit:
        assert found[0].matched_fields == fields


def test_finding_contents(record):
    found = {r.rule_id: r for r in scan(record, PACK).collect()}
    shell = found["iis_webshell_command_execution_query"]
    assert (shell.rule_title, shell.level, shell.src_ip, shell.status_code, shell.line_number, shell.raw_line) == \
        ("IIS Possible Web Shell Command Execution via Query String", "high", "198.51.100.77", 206, 1, "raw")
    assert shell.matched_fields == ["status", "uri_path", "uri_query_decoded"]
    assert shell.matched_values == ["206", "/Depot/Panel.ashx", "run=IPCONFIG&n=3"]
    assert shell.timestamp == "2025-11-19T23:04:59Z" and shell.category == "Webshell" and shell.tags == ["attack.t1505.003", "attack.t1059"]


def test_attack_and_clean_rows(spark):
    attack = raw(spark, FIELDS, {**FIELDS, "cs-uri-stem": "/list.asp", "cs-uri-query": "id=7+union%20select%20name", "cs(User-Agent)": "Nikto/2.5"},
                 {**FIELDS, "cs-uri-stem": "/get.cgi", "cs-uri-query": "doc=..%2F..%2F..%2Fetc%2Fpasswd"},
                 {**FIELDS, "cs-uri-stem": "/", "cs(User-Agent)": "${jndi:dns://h.example}"})
    ids = {r.rule_id for r in scan(attack, PACK).collect()}
    assert ids >= {"iis_webshell_command_execution_query", "iis_sql_injection_keywords", "iis_scanner_user_agent",
                   "iis_path_traversal", "iis_log4shell_payload"}
    assert {r.level for r in scan(attack, PACK, "critical").collect()} == {"critical"}
    clean = raw(spark, {**FIELDS, "cs-method": "GET", "cs-uri-stem": "/index.html", "cs-uri-query": "-", "cs(User-Agent)": "Mozilla/5.0"})
    assert scan(clean, PACK).count() == 0
    ordered = [(r.line_number, r.rule_seq) for r in in_scan_order(scan(attack, PACK)).collect()]
    assert ordered == sorted(ordered)


def test_no_rule_left(record):
    assert scan(record, [r for r in PACK if r.level != "critical"], "critical").count() == 0


@pytest.mark.parametrize("pattern_chars", [30_000, 400])
def test_literal_search_is_exact(spark, pattern_chars, monkeypatch):
    monkeypatch.setattr(literals, "MAX_PATTERN_CHARS", pattern_chars)
    rng = random.Random(3)
    wanted = sorted({v.lower() for r in PACK for b in r.branches for s in b.required for t in s if t.kind == "contains"
                     for v in t.operands} | {"aa", "aaa", "a[b", "é.", "(", "\\", "^$", "a\nb"})
    texts = ["".join(rng.choice(wanted)[rng.choice([0, 0, 1]):] + rng.choice(["", "x", "/"]) for _ in range(rng.randrange(5)))
             for _ in range(800)] + ["", "plain"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", literals.literal_hits(F.col("t"), wanted))
    sample = rng.sample(wanted, 60) + ["aa", "aaa", "("]
    frame = frame.select("t", *[literals.any_hit(F.col("h"), [w], wanted).alias(f"w{i}") for i, w in enumerate(sample)])
    for row in frame.collect():
        assert [bool(x) for x in row[1:]] == [w in row.t for w in sample], row.t


def test_scan_does_not_depend_on_partitions(spark):
    rows = [{**FIELDS, "cs-uri-query": q} for q in ("exec=dir", "p=%2e%2e%2f", "v=<svg onload=1>", "-") * 20]
    one, many = raw(spark, *rows).coalesce(1), raw(spark, *rows).repartition(16)
    shape = lambda f: sorted((r.rule_id, r.line_number, tuple(r.matched_values)) for r in scan(f, PACK).collect())
    assert shape(one) == shape(many)
