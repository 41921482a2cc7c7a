"""The registered queries in SQL, over the same tables.

Common table expressions: ``req`` turns events into request fields, ``rec`` normalises them,
``hit`` has one row per line rule and record it matches, ``f`` adds the rule's attributes.
"""

from __future__ import annotations

from math import ceil, floor

from wardlog.functions.clock import offset_seconds
from wardlog.functions.severity import LEVELS, REVIEW_LEVELS, at_least
from wardlog.operators.rules import FieldTest, Rule, Selection
from wardlog.plans.access_tables import (AGENTS, BURST_CLIENTS, BURST_PATH, BURST_RATE, BURST_START, ERROR_STATUS, ONCE_IN,
                                        ONCE_PATHS, PATTERNS, PERIOD, USERNAMES)
from wardlog.plans.queries import CSV_FIELDS, KEYED, LINES_PER_FILE, PACK, PARQUET_FROM, PREDICATES, W3C_ORDERS, ZONE
from wardlog.schema import FINDING_COLUMNS, FINDING_LIST_COLUMNS, INTEGER_COLUMNS, REVIEW_GROUPS, TIMELINE_COLUMNS, TOP_FIELDS

ISO = "%Y-%m-%dT%H:%M:%SZ"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


REQ = f"""
req0 AS (
  SELECT e.event_id, e.ts, e.user_id, e.value, e.event_type, p.url, e.event_id % {PERIOD} AS slot
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)),
req AS (
  SELECT event_id,
    strftime(ts, '%Y-%m-%d') AS "date", strftime(ts, '%H:%M:%S') AS "time",
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS "c-ip",
    CASE WHEN event_id % 50 = 7 THEN 'PUT' WHEN event_id % 50 = 13 THEN 'PROPFIND'
         WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS "cs-method",
    CASE WHEN slot < {len(PATTERNS)} THEN {texts(p for p, _ in PATTERNS)}[slot + 1]
         ELSE regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) END AS "cs-uri-stem",
    CASE WHEN slot < {len(PATTERNS)} THEN {texts(q for _, q in PATTERNS)}[slot + 1]
         ELSE coalesce(nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '-') END AS "cs-uri-query",
    CASE WHEN event_type = 'error' THEN {texts(map(str, ERROR_STATUS))}[event_id % {len(ERROR_STATUS)} + 1]
         ELSE '200' END AS "sc-status",
    {texts(AGENTS)}[user_id % {len(AGENTS)} + 1] AS "cs(User-Agent)",
    CASE WHEN event_id % 3 = 0 THEN '-' ELSE 'https://portal.example/start' END AS "cs(Referer)",
    CASE WHEN event_id % 11 < {len(USERNAMES)} THEN {texts(USERNAMES)}[event_id % 11 + 1] ELSE '-' END AS "cs-username",
    regexp_extract(url, '^https?://([^/]+)', 1) AS "cs-host",
    CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS "time-taken"
  FROM req0)"""


def decoded(expression: str) -> str:
    for _ in range(3):
        expression = f"url_decode(replace({expression}, '+', ' '))"
    return expression


REC = f"""
rec0 AS (
  SELECT event_id, "date", "time", "c-ip" AS src_ip, "cs-method" AS method, "cs-uri-stem" AS uri_path,
    nullif("cs-uri-query", '-') AS uri_query, TRY_CAST("sc-status" AS BIGINT) AS status,
    nullif("cs(User-Agent)", '-') AS user_agent, nullif("cs(Referer)", '-') AS referer,
    nullif("cs-username", '-') AS username, "cs-host" AS host, TRY_CAST("time-taken" AS BIGINT) AS time_taken,
    443 AS "s-port", 'events' AS log_file, event_id + 1 AS line_number,
    concat_ws(' ', "date", "time", "c-ip", "cs-method", "cs-uri-stem") AS raw_line
  FROM req),
rec1 AS (
  SELECT *, CASE WHEN length(uri_path) > 0 AND length(uri_query) > 0 THEN uri_path || '?' || uri_query
                 ELSE uri_path END AS url_original,
    {decoded("uri_path")} AS uri_path_decoded, {decoded("uri_query")} AS uri_query_decoded
  FROM rec0),
rec AS MATERIALIZED (
  SELECT *, {decoded("url_original")} AS url_decoded,
    CAST("date" || ' ' || "time" AS TIMESTAMP) AS ts,
    strftime(CAST("date" || ' ' || "time" AS TIMESTAMP), '{ISO}') AS "timestamp",
    coalesce(status BETWEEN 200 AND 399, FALSE) AS is_success_status, coalesce(status >= 400, FALSE) AS is_error_status,
    lower(nullif(regexp_extract(split_part(uri_path_decoded, '?', 1), '[^/.][^/]*(\\.[^/.]*)$', 1), '')) AS extension
  FROM rec1)"""

WITH_REC = f"WITH RECURSIVE {REQ},{REC}"

BURST = f"""
burst AS (
  SELECT * REPLACE (
    strftime(make_timestamp(({BURST_START} + event_id // {BURST_RATE}) * 1000000), '%Y-%m-%d') AS "date",
    strftime(make_timestamp(({BURST_START} + event_id // {BURST_RATE}) * 1000000), '%H:%M:%S') AS "time",
    '10.9.0.' || (event_id % {BURST_CLIENTS}) AS "c-ip",
    CASE WHEN event_id % {ONCE_IN} = 0 THEN replace({text(ONCE_PATHS[0])}, '%d', CAST(event_id AS VARCHAR))
         WHEN event_id % {ONCE_IN} = 1 THEN replace({text(ONCE_PATHS[1])}, '%d', CAST(event_id AS VARCHAR))
         WHEN event_id % 4 <> 0 THEN {text(BURST_PATH)} ELSE "cs-uri-stem" END AS "cs-uri-stem") FROM req)"""
WITH_BURST = f"WITH RECURSIVE {REQ},{BURST},{REC.replace('FROM req)', 'FROM burst)')}"


def test_sql(test: FieldTest) -> str:
    column = f'"{test.name}"'
    low = f"lower(CAST({column} AS VARCHAR))"
    wanted = [text(v.lower()) for v in test.operands] if test.kind not in ("bounds", "re") else []
    if test.kind == "exists":
        return f"{column} IS NOT NULL"
    if test.kind == "not_exists":
        return f"{column} IS NULL"
    signs = {"gte": ">=", "gt": ">", "lte": "<=", "lt": "<"}
    any_of = {
        "equals": lambda: [f"{low} IN ({', '.join(wanted)})"],
        "contains": lambda: [f"contains({low}, {w})" for w in wanted],
        "startswith": lambda: [f"starts_with({low}, {w})" for w in wanted],
        "endswith": lambda: [f"ends_with({low}, {w})" for w in wanted],
        "re": lambda: [f"regexp_matches(CAST({column} AS VARCHAR), {text(p)}, 'i')" for p in test.operands],
        "bounds": lambda: [" AND ".join(f"{column} {signs[op]} {bound}" for op, bound in test.operands)],
    }[test.kind]()
    return f"coalesce({' OR '.join(any_of)}, FALSE)"


def selection_sql(selection: Selection) -> str:
    return " AND ".join(map(test_sql, selection)) or "TRUE"


def rule_sql(rule: Rule) -> list[tuple[str, tuple[str, ...]]]:
    """Condition and evidence names of every branch; a later branch excludes the earlier ones."""
    found = []
    for branch in rule.branches:
        parts = [f"({selection_sql(s)})" for s in branch.required]
        if branch.excluded is not None:
            parts.append(f"NOT ({selection_sql(branch.excluded)})")
        parts += [f"NOT ({earlier})" for earlier, _ in found]
        found.append((" AND ".join(parts), branch.evidence))
    return found


def hits_sql(rules: list[Rule], min_level: str = "low") -> str:
    arms = []
    for seq, rule in enumerate(rules):
        if rule.grouping is not None or not at_least(rule.level, min_level):
            continue
        for condition, names in rule_sql(rule):
            values = " || ';' || ".join(f'CAST("{n}" AS VARCHAR)' for n in names) or "''"
            arms.append(f"SELECT {seq} AS rule_seq, {text(';'.join(names))} AS matched_fields, "
                        f"{values} AS matched_values, * FROM rec WHERE {condition}")
    return "hit AS (\n  " + "\n  UNION ALL ".join(arms) + ")"


def catalog_sql(rules: list[Rule]) -> str:
    rows = ", ".join(
        f"({seq}, {text(r.id)}, {text(r.title)}, {text(r.level)}, {text(r.status)}, {text(r.type)}, {text(r.category)}, "
        f"{text(r.description)}, {text(';'.join(r.tags))}, {text(';'.join(r.falsepositives))}, {text(';'.join(r.references))})"
        for seq, r in enumerate(rules))
    return (f"catalog AS (SELECT * FROM (VALUES {rows}) AS c(rule_seq, rule_id, rule_title, level, rule_status, type, "
            'category, description, tags, falsepositives, "references"))')


def findings_with(rules: list[Rule] = PACK, min_level: str = "low") -> str:
    return (f"{WITH_REC}, {hits_sql(rules, min_level)}, {catalog_sql(rules)}, "
            "f AS MATERIALIZED (SELECT * FROM hit JOIN catalog USING (rule_seq))")


def keyed_arm(rule: Rule, name: str) -> tuple[str, str]:
    """Common table expressions and the final SELECT of one keyed rule."""
    g = rule.grouping
    present = " AND ".join(f'"{k}" IS NOT NULL' for k in g.keys)
    key = " || ';' || ".join(f'CAST("{k}" AS VARCHAR)' for k in g.keys)
    counted = selection_sql(g.where)
    if g.kind == "sequence":
        follow = selection_sql(g.followed_by)
        role = f"CASE WHEN {follow} THEN 2 WHEN {counted} THEN 1 END"
    else:
        role = f"CASE WHEN {counted} THEN 1 END"
    ctes = f"""{name}_m AS (SELECT {key} AS k, CAST(epoch(ts) AS BIGINT) AS sec, {role} AS role, "timestamp", log_file, line_number
      FROM rec WHERE {present} AND ts IS NOT NULL AND {role} IS NOT NULL)"""
    out = (f"{text(rule.id)} AS rule_id, {text(rule.level)} AS level, \"timestamp\", line_number, "
           f"{text(';'.join((*g.keys, 'event_count')))} AS matched_fields, ")
    if g.kind == "rarity":
        return ctes, (f"SELECT {out} k || ';' || n AS matched_values FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n, "
                      f"row_number() OVER (PARTITION BY k ORDER BY log_file, line_number) AS first FROM {name}_m) "
                      f"WHERE n <= {g.at_most} AND first = 1")
    seconds = g.window_minutes * 60
    trigger = 2 if g.kind == "sequence" else 1
    ctes += f""",
    {name}_c AS (SELECT *, count(*) FILTER (role = 1) OVER (PARTITION BY k ORDER BY sec RANGE BETWEEN {floor(seconds)} PRECEDING AND CURRENT ROW)
        - count(*) FILTER (role = 1) OVER (PARTITION BY k, sec ORDER BY log_file, line_number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n
      FROM {name}_m),
    {name}_d AS (SELECT * FROM {name}_c WHERE role = {trigger} AND n >= {g.at_least}
      QUALIFY row_number() OVER (PARTITION BY k, sec ORDER BY log_file, line_number) = 1),
    {name}_f AS (SELECT k, min(sec) AS sec FROM {name}_d GROUP BY k
      UNION ALL SELECT d.k, min(d.sec) FROM {name}_f f JOIN {name}_d d ON d.k = f.k AND d.sec >= f.sec + {ceil(seconds)} GROUP BY d.k)"""
    return ctes, f"SELECT {out} k || ';' || n AS matched_values FROM {name}_d JOIN {name}_f USING (k, sec)"


def keyed_sql(*rules: Rule, source: str = WITH_REC) -> str:
    arms = [keyed_arm(rule, f"a{i}") for i, rule in enumerate(rules)]
    return f"{source},\n" + ",\n".join(c for c, _ in arms) + "\n" + "\nUNION ALL ".join(s for _, s in arms)


PLACE = f"event_id % {LINES_PER_FILE}"
HALF = LINES_PER_FILE // 2
LOG = f"""log AS (SELECT *, event_id // {LINES_PER_FILE} AS file_no,
    {PLACE} + CASE WHEN {PLACE} < {HALF} THEN 3 ELSE 5 END AS log_line, {PLACE} >= {HALF} AS late FROM rec)"""
CSV = f"""csv AS (SELECT rec.*, event_id // {LINES_PER_FILE} AS file_no,
    2 + event_id % {LINES_PER_FILE} + 1 + count(*) FILTER (event_id % 40 = 3) OVER (
      PARTITION BY event_id // {LINES_PER_FILE} ORDER BY event_id) AS csv_line,
    CASE WHEN event_id % 40 = 3 THEN 'two' || chr(10) || 'lines, "quoted"' WHEN event_id % 7 = 0 THEN 'a,b' END AS note
  FROM rec)"""


def review_sql(by: str) -> str:
    group = {"category": "category", "level": "level", "rule": "rule_id"}.get(by) or f"coalesce(nullif({by}, ''), '(none)')"
    rank = f"list_position({texts(REVIEW_LEVELS)}, level)"
    return f"""{findings_with()},
    g AS (SELECT *, {group} AS review_group, count(*) OVER (PARTITION BY {group}) AS group_size,
      row_number() OVER (PARTITION BY {group} ORDER BY {rank}, "timestamp", log_file, line_number, rule_seq) AS row_in_group FROM f)
    SELECT review_group, group_size, greatest(group_size - 100, 0) AS hidden, row_in_group, rule_id, level, "timestamp", line_number
    FROM g WHERE row_in_group <= 100"""


def top_sql(source: str, field: str, limit: int) -> str:
    return (f"SELECT CAST({field} AS VARCHAR) AS value, count(*) AS count FROM {source} WHERE {field} IS NOT NULL "
            f"GROUP BY {field} ORDER BY count DESC, CAST({field} AS VARCHAR) LIMIT {limit}")


def all_oracles() -> dict[str, str]:
    finding_texts = ", ".join({"status": "rule_status AS status", "status_code": "status AS status_code"}.get(c, f'"{c}"')
                              for c in FINDING_COLUMNS)
    line_counts = hits_sql(PACK)
    low_level = findings_with()
    keyed_pack = [r for r in PACK if r.grouping is not None]
    keyed_pack_arms = [keyed_arm(r, f"p{i}") for i, r in enumerate(keyed_pack)]
    counting = [*PREDICATES.values()]
    counted_arms = [keyed_arm(KEYED[n], f"a{i}") for i, n in enumerate(("threshold", "rarity"))]
    timeline_columns = ", ".join(
        f'"{c}"' if c not in ("site_name", "server_ip", "substatus", "win32_status", "bytes_sent", "bytes_received")
        else f"CAST(NULL AS {'BIGINT' if c in INTEGER_COLUMNS else 'VARCHAR'}) AS {c}" for c in TIMELINE_COLUMNS)
    written_texts = ", ".join({"status": "rule_status AS status", "status_code": "status AS status_code"}.get(c, f"nullif(\"{c}\", '') AS \"{c}\"" if c in FINDING_LIST_COLUMNS else f'"{c}"')
                              for c in FINDING_COLUMNS)
    parsed_log = f"""{WITH_REC}, {LOG} SELECT file_no, log_line AS line_number, "timestamp", src_ip, method, uri_path, uri_query,
            status, CASE WHEN NOT late THEN user_agent END AS user_agent, CASE WHEN late THEN time_taken END AS time_taken,
            CASE WHEN late THEN host END AS host FROM log WHERE event_id % 101 <> 5"""
    rejected_log = f"""{WITH_REC}, {LOG} SELECT file_no, log_line AS line_number,
            CASE WHEN late THEN '{len(W3C_ORDERS[1]) + 1} values under {len(W3C_ORDERS[1])} field names'
                 ELSE '{len(W3C_ORDERS[0]) + 1} values under {len(W3C_ORDERS[0])} field names' END AS reason
            FROM log WHERE event_id % 101 = 5"""
    streamed = [keyed_arm(KEYED[n], f"s{i}") for i, n in enumerate(("threshold", "threshold_composite_key", "sequence"))]

    def keyed_counts(final: str, with_lines: bool = True) -> str:
        """Findings of the streamed keyed rules, and of the line rules, as `every`; then a SELECT over it."""
        lines = "SELECT rule_id, level FROM hit JOIN catalog USING (rule_seq) UNION ALL " if with_lines else ""
        keyed = " UNION ALL ".join(f"SELECT rule_id, level FROM ({s})" for _, s in streamed)
        return f"{WITH_REC}, {line_counts}, {catalog_sql(PACK)}, " + ", ".join(c for c, _ in streamed) + f", every AS ({lines}{keyed}) {final}"

    shift = offset_seconds(ZONE)
    return {
        "normalize_fields": f"""{WITH_REC} SELECT line_number, "timestamp", "date", "time", CAST(NULL AS VARCHAR) AS site_name,
            method, uri_path, uri_query, src_ip, username, user_agent, referer, status, CAST(NULL AS BIGINT) AS substatus,
            time_taken, host, '443' AS s_port FROM rec""",
        "url_decode": f"{WITH_REC} SELECT line_number, url_original, uri_path_decoded, uri_query_decoded, url_decoded FROM rec",
        "url_parts_extension": f"{WITH_REC} SELECT line_number, host, uri_path, uri_query, url_original, extension FROM rec",
        "status_flags": f"{WITH_REC} SELECT status, is_success_status, is_error_status, count(*) AS n FROM rec GROUP BY ALL",
        "timestamp_offset": f"""{WITH_REC} SELECT line_number, strftime(ts - INTERVAL {shift} SECOND, '{ISO}') AS "timestamp" FROM rec""",
        "w3c_parse": parsed_log,
        "w3c_rejects": rejected_log,
        "w3c_header_rejects": f"""{WITH_REC}, {LOG} SELECT file_no, log_line AS line_number,
            CASE WHEN late THEN '{len(W3C_ORDERS[1]) + 1} values under {len(W3C_ORDERS[1])} field names'
                 ELSE '{len(W3C_ORDERS[0]) + 1} values under {len(W3C_ORDERS[0])} field names' END AS reason
            FROM log WHERE event_id % 101 = 5 AND (file_no % 3 = 0 OR file_no % 3 = 2 AND NOT late)
            UNION ALL SELECT file_no, log_line, 'row without a layout; the file is not read beyond it' FROM log
            WHERE file_no % 3 = 1 AND {PLACE} = 0 OR file_no % 3 = 2 AND {PLACE} = {HALF}
            UNION ALL SELECT file_no, log_line - 1, '#Fields: line without names' FROM log WHERE file_no % 3 = 2 AND {PLACE} = {HALF}""",
        "csv_parse": f"""{WITH_REC}, {CSV} SELECT file_no, csv_line AS line_number, src_ip, method, uri_path, uri_query, status,
            user_agent, note FROM csv WHERE event_id % 101 <> 5""",
        "csv_rejects": f"""{WITH_REC}, {CSV} SELECT file_no, csv_line AS line_number,
            '{len(CSV_FIELDS) + 2} cells under {len(CSV_FIELDS) + 1} column names' AS reason FROM csv WHERE event_id % 101 = 5""",
        "csv_multiline_header": f"""{WITH_REC}, {CSV} SELECT file_no, csv_line + 2 AS line_number, src_ip, coalesce(note, '-') AS note
            FROM csv WHERE event_id % 101 <> 5""",
        "read_logs_mixed": f"""{WITH_REC}, {LOG} SELECT CASE WHEN event_id % 101 <> 5 THEN 'log row'
                WHEN late THEN '{len(W3C_ORDERS[1]) + 1} values under {len(W3C_ORDERS[1])} field names'
                ELSE '{len(W3C_ORDERS[0]) + 1} values under {len(W3C_ORDERS[0])} field names' END AS kind, count(*) AS n FROM log GROUP BY ALL
            UNION ALL SELECT CASE WHEN event_id % 101 <> 5 THEN 'csv row'
                ELSE '{len(CSV_FIELDS) + 2} cells under {len(CSV_FIELDS) + 1} column names' END, count(*) FROM rec GROUP BY ALL
            UNION ALL SELECT 'cannot be read to its end', 1 UNION ALL SELECT 'not found', 1""",
        **{name: f"{WITH_REC} SELECT line_number, src_ip FROM rec WHERE "
                 + " OR ".join(f"({c})" for c, _ in rule_sql(rule)) for name, rule in PREDICATES.items()},
        "scan_pack": f"{low_level} SELECT rule_id, line_number FROM f",
        "scan_evidence": f"{low_level} SELECT rule_id, line_number, matched_fields, matched_values FROM f",
        "findings_flat": f"{low_level} SELECT {finding_texts} FROM f",
        "findings_json_roundtrip": f"{low_level} SELECT {finding_texts.replace(', "raw_line"', '')} FROM f",
        "findings_csv_roundtrip": f"{low_level} SELECT {written_texts} FROM f",
        "parquet_roundtrip": f"""{low_level} SELECT strftime(ts, '%Y-%m-%d') AS day, rule_id, line_number, "timestamp", src_ip FROM f
            WHERE strftime(ts, '%Y-%m-%d') >= {text(PARQUET_FROM)}""",
        "min_level": f"{findings_with(PACK, 'critical')} SELECT rule_id, level, count(*) AS n FROM f GROUP BY ALL",
        **{name: keyed_sql(rule) for name, rule in KEYED.items()},
        "multi_agg": keyed_sql(*KEYED.values()),
        "pack_hunt": f"{WITH_REC}, {line_counts}, {catalog_sql(PACK)}, " + ", ".join(c for c, _ in keyed_pack_arms)
                     + ", every AS (SELECT rule_id FROM hit JOIN catalog USING (rule_seq) "
                     + " ".join(f"UNION ALL SELECT rule_id FROM ({s})" for _, s in keyed_pack_arms)
                     + ") SELECT rule_id, rule_title, level, count(*) AS hits FROM every JOIN catalog USING (rule_id) GROUP BY ALL",
        "pack_keyed": keyed_sql(*keyed_pack, source=WITH_BURST),
        **{f"top_{field}": f"{WITH_REC} {top_sql('rec', field, 20)}" for field in TOP_FIELDS},
        "timeline": f"{WITH_REC} SELECT {timeline_columns} FROM rec",
        "timeline_csv_roundtrip": f"{WITH_REC} SELECT {timeline_columns} FROM rec",
        "timeline_positions": f"""{WITH_REC} SELECT row_number() OVER (ORDER BY ts NULLS FIRST, line_number, log_file) AS position, "timestamp",
            line_number, src_ip, uri_path FROM rec""",
        "findings_by_severity": f"""{low_level} SELECT l.level, count(f.rule_id) AS findings FROM unnest({texts(LEVELS)}) AS l(level)
            LEFT JOIN f ON f.level = l.level GROUP BY l.level""",
        "top_finding_sources": f"{low_level} {top_sql('f', 'src_ip', 10)}",
        "top_finding_paths": f"{low_level} {top_sql('f', 'uri_path', 10)}",
        "top_finding_agents": f"{low_level} {top_sql('f', 'user_agent', 10)}",
        "rule_hits": f"{low_level} SELECT rule_id, rule_title, level, count(*) AS hits FROM f GROUP BY ALL",
        "category_summary": f"{low_level} SELECT category, count(*) AS n FROM f GROUP BY ALL",
        "rule_catalog_hits": f"""{low_level} SELECT c.rule_id, c.level, c.type, c.category, c.tags, h.hits FROM catalog c
            LEFT JOIN (SELECT rule_id, count(*) AS hits FROM f GROUP BY ALL) h USING (rule_id)""",
        **{f"grouped_review_{by}": review_sql(by) for by in REVIEW_GROUPS},
        "review_without_limit": review_sql("level").replace("greatest(group_size - 100, 0)", "0").replace("WHERE row_in_group <= 100", ""),
        "highest_severity": f"{low_level} SELECT arg_min(level, list_position({texts(REVIEW_LEVELS)}, level)) AS highest_severity FROM f",
        "run_stats": f"""{WITH_REC}, {LOG}, part AS (SELECT * REPLACE (
                CASE WHEN NOT late THEN user_agent END AS user_agent, CAST(NULL AS VARCHAR) AS referer,
                CAST(NULL AS VARCHAR) AS username) FROM log WHERE event_id % 101 <> 5),
            {hits_sql(PACK).replace('FROM rec', 'FROM part')}
            SELECT (SELECT count(DISTINCT file_no) FROM log) AS files_parsed, (SELECT count(*) FROM part) AS lines_parsed,
              (SELECT count(*) FROM log WHERE event_id % 101 = 5) AS skipped, (SELECT count(*) FROM hit) AS findings,
              (SELECT count(DISTINCT rule_seq) FROM hit) AS rules_hit""",
        "report_detail": f"""{low_level} SELECT "timestamp", level, rule_id, src_ip, method, uri_path, uri_query,
            status AS status_code, line_number FROM f ORDER BY log_file, line_number, rule_seq LIMIT 200""",
        "report_positions": f"""{low_level} SELECT row_number() OVER (ORDER BY log_file, line_number, rule_seq) AS position, rule_id, line_number
            FROM f ORDER BY position LIMIT 200""",
        "report_tables": f"""{low_level},
            severities AS (SELECT l.level AS value, count(f.rule_id) AS n FROM unnest({texts(LEVELS)}) AS l(level) LEFT JOIN f ON f.level = l.level GROUP BY l.level),
            {", ".join(f"{field}_top AS ({top_sql('f', field, 10)})" for field in ("src_ip", "uri_path", "user_agent"))}
            SELECT 'findings_by_severity' AS section, value, n FROM severities
            UNION ALL SELECT 'top_source_ips', value, count FROM src_ip_top UNION ALL SELECT 'top_uri_paths', value, count FROM uri_path_top
            UNION ALL SELECT 'top_user_agents', value, count FROM user_agent_top
            UNION ALL SELECT 'rule_hits', rule_id, count(*) FROM f GROUP BY rule_id""",
        "event_counts": f"{WITH_REC}, {hits_sql(counting)}, {catalog_sql(counting)}, " + ", ".join(c for c, _ in counted_arms)
                        + ", every AS (SELECT rule_id, NULL AS event_count FROM hit JOIN catalog USING (rule_seq) "
                        + " ".join(f"UNION ALL SELECT rule_id, split_part(matched_values, ';', -1) FROM ({s})" for _, s in counted_arms)
                        + ") SELECT rule_id, event_count, count(*) AS n FROM every GROUP BY ALL",
        "stream_scan": f"{low_level} SELECT rule_id, line_number FROM f",
        "stream_threshold": keyed_sql(KEYED["threshold"], KEYED["threshold_composite_key"]),
        "stream_sequence": keyed_sql(KEYED["sequence"]),
        "stream_w3c_files": parsed_log,
        "stream_w3c_rejects": rejected_log,
        "stream_files_scan": f"""{WITH_REC}, {LOG}, part AS (SELECT * REPLACE (
                CASE WHEN NOT late THEN user_agent END AS user_agent, CAST(NULL AS VARCHAR) AS referer,
                CAST(NULL AS VARCHAR) AS username) FROM log WHERE event_id % 101 <> 5),
            {hits_sql(PACK).replace('FROM rec', 'FROM part')}, {catalog_sql(PACK)}
            SELECT rule_id, file_no, log_line AS line_number FROM hit JOIN catalog USING (rule_seq)""",
        "stream_state_expiry": keyed_counts("SELECT rule_id, count(*) AS findings, 0 AS state_rows FROM every GROUP BY rule_id", with_lines=False),
        "stream_top_findings": keyed_counts(
            "SELECT rule_id, coalesce(rule_title, rule_id) AS rule_title, e.level, count(*) AS hits FROM every e LEFT JOIN catalog USING (rule_id) GROUP BY ALL "
            "ORDER BY hits DESC, rule_id LIMIT 10"),
        "stream_findings_by_severity": keyed_counts(
            f"SELECT l.level, count(e.rule_id) AS findings FROM unnest({texts(LEVELS)}) AS l(level) LEFT JOIN every e ON e.level = l.level GROUP BY l.level"),
        "stream_top_sources": f"{WITH_REC} SELECT src_ip, count(*) AS count FROM rec GROUP BY src_ip ORDER BY count DESC, src_ip LIMIT 10",
        "stream_running_counts": f"{WITH_REC} SELECT src_ip, count(*) AS count FROM rec GROUP BY src_ip",
    }


