"""Column names of records and findings.

Fixed values: the W3C names, the record columns and the finding columns are the public data model.
"""

from __future__ import annotations

# W3C field name -> record column.
W3C_COLUMNS = {
    "date": "date",
    "time": "time",
    "s-sitename": "site_name",
    "s-ip": "server_ip",
    "cs-method": "method",
    "cs-uri-stem": "uri_path",
    "cs-uri-query": "uri_query",
    "c-ip": "src_ip",
    "cs-username": "username",
    "cs(User-Agent)": "user_agent",
    "cs(Referer)": "referer",
    "sc-status": "status",
    "sc-substatus": "substatus",
    "sc-win32-status": "win32_status",
    "sc-bytes": "bytes_sent",
    "cs-bytes": "bytes_received",
    "time-taken": "time_taken",
    "cs-host": "host",
}

INTEGER_COLUMNS = ("status", "substatus", "win32_status", "bytes_sent", "bytes_received", "time_taken")

DERIVED_COLUMNS = ("timestamp", "url_original", "uri_path_decoded", "uri_query_decoded", "url_decoded",
                   "is_success_status", "is_error_status", "extension")

PROVENANCE_COLUMNS = ("raw_line", "log_file", "line_number")

TIMELINE_COLUMNS = (
    "timestamp", "date", "time", "site_name", "server_ip", "method", "uri_path", "uri_query", "src_ip",
    "username", "user_agent", "referer", "status", "substatus", "win32_status", "bytes_sent",
    "bytes_received", "time_taken", "host", "extension", "log_file", "line_number",
)

# Record columns that a finding repeats (record column -> finding column).
FINDING_RECORD_COLUMNS = {
    "timestamp": "timestamp", "src_ip": "src_ip", "method": "method", "uri_path": "uri_path",
    "uri_query": "uri_query", "status": "status_code", "user_agent": "user_agent",
    "referer": "referer", "host": "host",
    "log_file": "log_file", "line_number": "line_number", "raw_line": "raw_line",
}

FINDING_COLUMNS = (
    "rule_id", "rule_title", "level", "status", "description", "timestamp", "src_ip", "method",
    "uri_path", "uri_query", "status_code", "user_agent", "referer", "host", "matched_fields",
    "matched_values", "tags", "falsepositives", "references", "log_file", "line_number", "raw_line",
)
FINDING_LIST_COLUMNS = ("matched_fields", "matched_values", "tags", "falsepositives", "references")

# Fields offered for top-N counts and for grouping findings in a review.
TOP_FIELDS = ("src_ip", "uri_path", "user_agent", "status", "method", "extension", "host")
REVIEW_GROUPS = ("category", "level", "rule", "src_ip", "host")
