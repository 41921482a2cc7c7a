"""Whole hunts over log files with the bundled pack."""

from pathlib import Path

import pytest

from wardlog.plans.hunt import hunt_logs

FIELDS = ("#Fields: date time s-ip cs-method cs-uri-stem cs-uri-query c-ip cs-username cs(User-Agent) cs(Referer) sc-status "
          "sc-substatus sc-win32-status time-taken")


def write(folder: Path, name: str, rows) -> None:
    (folder / name).write_text("#Software: x\n#Version: 1.0\n" + FIELDS + "\n" + "\n".join(rows) + "\n")


def row(time, path, query="-", ip="198.51.100.9", agent="fetch/1", status=200):
    return f"2025-11-19 {time} 10.0.0.5 GET {path} {query} {ip} - {agent} - {status} 0 0 45"


@pytest.mark.parametrize("staged", [False, True])
def test_attack_log(spark, tmp_path, staged):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs, "attack.log", [
        row("04:00:09", "/kit/do.ashx", "exec=certutil"), row("04:10:00", "/items.asp", "id=9%20union%20select%20x", agent="Nikto/2.5", status=500),
        row("04:20:00", "/fetch.asmx", "doc=..%2f..%2fboot.ini"), row("04:30:00", "/err.html", "u=${jndi:dns://q}", status=404),
        row("04:40:00", "/start.html", ip="203.0.113.20", agent="Opera/9")])
    flood = [row(f"11:{i // 60:02d}:{i % 60:02d}", f"/missing{i}", ip="9.9.9.9", status=404) for i in range(150)]
    guess = [row(f"12:00:{i:02d}", "/x", ip="8.8.8.8", status=401) for i in range(30)] + [row("12:01:00", "/x", ip="8.8.8.8")]
    write(logs, "busy.log", flood + guess)
    result = hunt_logs(spark, str(logs), staging=str(tmp_path / "records") if staged else None)
    found = {(r.rule_id, r.line_number): r for r in result.findings.collect()}
    ids = {rule_id for rule_id, _ in found}
    assert ids >= {"iis_webshell_command_execution_query", "iis_sql_injection_keywords", "iis_scanner_user_agent",
                   "iis_path_traversal", "iis_log4shell_payload"}
    shell = found["iis_webshell_command_execution_query", 4]
    assert shell.src_ip == "198.51.100.9" and shell.raw_line.startswith("2025-11-19 04:00:09") and shell.log_file.endswith("/attack.log")
    # The flood fires on its 100th row, the guesses on the success after 30 failures.
    assert found["iis_high_404_single_source", 103].matched_values == ["9.9.9.9", "100"]
    assert found["iis_bruteforce_then_success", 184].matched_values == ["8.8.8.8", "30"]
    assert [k for k in found if k[0] in ("iis_high_404_single_source", "iis_bruteforce_then_success")] != []
    rare = sorted(r.uri_path for r in found.values() if r.rule_id == "iis_rare_successful_dynamic_extension")
    assert rare == ["/fetch.asmx", "/kit/do.ashx"]
    assert result.records.count() == 186 and result.rejects.count() == 0 and result.rule_problems == []


def test_clean_log_and_own_rules(spark, tmp_path):
    write(tmp_path, "clean.log", [row("09:00:01", "/index.html", agent="Mozilla/5.0+(Windows)"), row("09:00:02", "/homepage.html", agent="Mozilla/5.0+(Windows)")])
    assert hunt_logs(spark, str(tmp_path)).findings.count() == 0
    (tmp_path / "mine.yml").write_text("id: mine\ntitle: t\nlevel: low\ndetection: {selection: {s-ip: 10.0.0.5, sc-win32-status|exists: 1}}\n")
    # A raw name that the schema renames is not a rule field; its column name is.
    assert hunt_logs(spark, str(tmp_path), str(tmp_path / "mine.yml")).findings.count() == 0
    (tmp_path / "mine.yml").write_text("id: mine\ntitle: t\nlevel: low\ndetection: {selection: {server_ip: 10.0.0.5, uri_path|contains: home}}\n")
    assert hunt_logs(spark, str(tmp_path), str(tmp_path / "mine.yml")).findings.count() == 1
