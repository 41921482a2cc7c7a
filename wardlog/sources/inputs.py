"""Inputs of a hunt: a file, a folder, a glob, or several of these."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import SparkSession

from wardlog.sources.csv_export import read_csv
from wardlog.sources.lines import LINE_COLUMNS, REJECT_COLUMNS, LogSource
from wardlog.sources.w3c import read_w3c


def _system(spark: SparkSession, spec: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(spec)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _below(spark: SparkSession, folder: str) -> list[str]:
    """All files under a folder."""
    path, system = _system(spark, folder)
    found, files = [], system.listFiles(path, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return sorted(found)


def _pattern(glob: str) -> str:
    """Regular expression of a glob in which ``**/`` stands for any folders, none included."""
    out = ""
    for token in re.findall(r"\*\*/|\*\*|\*|\?|\[!?[^\]]+\]|.", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(
            token, token.replace("[!", "[^") if token.startswith("[") and len(token) > 1 else re.escape(token))
    return out


def _glob_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files (not folders) that match, from the file system of the path; ``**`` goes down into folders."""
    if "**" in pattern:
        base = pattern[: re.search(r"[*?\[{]", pattern).start()].rpartition("/")[0] or ("/" if pattern.startswith("/") else ".")
        path, system = _system(spark, base)
        if not system.exists(path):
            return []
        root = system.getFileStatus(path).getPath().toString().rstrip("/")
        inner = re.compile(_pattern(pattern[len(base):].lstrip("/")) + r"\Z")
        return [f for f in _below(spark, base) if inner.match(f[len(root) + 1:])]
    path, system = _system(spark, pattern)
    return sorted(s.getPath().toString() for s in system.globStatus(path) or () if s.isFile())


def _kind(spark: SparkSession, spec: str) -> str:
    """What a path names as it stands, whatever characters its name has: ``folder``, ``file`` or nothing."""
    path, system = _system(spark, spec)
    if not system.exists(path):
        return ""
    return "folder" if system.getFileStatus(path).isDirectory() else "file"


def _literal(path: str) -> str:
    """A path for the readers, which take ``[``, ``{``, ``*`` and ``?`` for patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _hidden(path: str) -> bool:
    """Names that the file sources of Spark pass over."""
    return path.rsplit("/", 1)[-1].startswith(("_", "."))


def read_logs(spark: SparkSession, spec: str | Sequence[str], strict: bool = False) -> LogSource:
    """Raw rows of log files.

    A path that exists is taken as it is; a folder is searched recursively for ``*.log`` and ``*.csv``; anything
    else is a glob that takes every file it matches, ``**`` in any folder below. Files whose name begins with
    ``_`` or ``.`` are not readable by Spark and become rejects. Names ending in ``.csv`` are CSV exports, all others W3C logs. Without any match this
    raises ``FileNotFoundError``; in a list of several inputs a missing one becomes a reject. With ``strict`` a
    reject of a whole file raises ``SourceError``, and the job that meets a line that would be skipped fails.
    """
    specs = [spec] if isinstance(spec, str) else list(spec)
    parts: list[LogSource] = []
    files: list[str] = []
    missing: list[str] = []
    hidden: list[str] = []
    for one in specs:
        kind = _kind(spark, one)
        if kind == "folder":
            folder = _literal(one)
            parts += [read_w3c(spark, [folder], "*.log"), read_csv(spark, [folder], "*.csv")]
            hidden += [f for f in _below(spark, one) if _hidden(f) and f.endswith((".log", ".csv"))]
        else:
            found = [one] if kind else _glob_files(spark, one)
            hidden += [f for f in found if _hidden(f)]
            named = len(found)
            found = [_literal(f) for f in found if not _hidden(f)]
            files += found
            if not named:
                missing.append(one)
    if missing and len(missing) == len(specs):
        raise FileNotFoundError(f"nothing to read at {spec!r}")
    exports = [f for f in files if f.lower().endswith(".csv")]
    logs = [f for f in files if not f.lower().endswith(".csv")]
    if logs:
        parts.append(read_w3c(spark, logs))
    if exports:
        parts.append(read_csv(spark, exports))
    if not parts:
        parts.append(LogSource(spark.createDataFrame([], LINE_COLUMNS), spark.createDataFrame([], REJECT_COLUMNS)))
    source = parts[0]
    for part in parts[1:]:
        source = source.union(part)
    if missing or hidden:
        unread = [(m, 0, "not found") for m in missing] + [(re.sub("^file:(//)?(?=/)", "", h), 0, "hidden file name, not read") for h in hidden]
        source = LogSource(source.lines, source.notices.unionByName(spark.createDataFrame(unread, REJECT_COLUMNS)))
    return source.strict() if strict else source
