"""Text expressions: lenient URL decoding, URL assembly, file extension."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DECODE_PASSES = 3  # fixed value


def text_array(values: Iterable[str]) -> Column:
    """Constant array of strings, handed to the JVM in one call and folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def _decode_once(text: Column) -> Column:
    # A percent sign without two hex digits stays literal, so it is escaped before decoding.
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25"))


def url_decode(text: Column) -> Column:
    """Decode percent escapes and ``+`` up to three times; text without either is left alone."""
    decoded = text
    for _ in range(DECODE_PASSES):
        decoded = _decode_once(decoded)
    return F.when(text.rlike("[%+]"), decoded).otherwise(text)


def join_url(path: Column, query: Column) -> Column:
    """``path?query`` when both are non-empty, else the path."""
    return F.when((F.length(path) > 0) & (F.length(query) > 0), F.concat(path, F.lit("?"), query)).otherwise(path)


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot; leading dots of a file name do not start one."""
    name = F.substring_index(path, "?", 1)
    suffix = F.regexp_extract(name, r"(?s)[^/.][^/]*(\.[^/.]*)\z", 1)
    return F.lower(F.nullif(suffix, F.lit("")))
