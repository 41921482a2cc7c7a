"""Raw W3C fields -> typed records with derived columns (see ``wardlog.schema``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.functions.clock import event_time, use_utc
from wardlog.functions.text import file_extension, join_url, text_array, url_decode
from wardlog.schema import DERIVED_COLUMNS, INTEGER_COLUMNS, PROVENANCE_COLUMNS, W3C_COLUMNS

_KNOWN = sorted({*W3C_COLUMNS, *W3C_COLUMNS.values(), *DERIVED_COLUMNS, *PROVENANCE_COLUMNS})


def _present(text: Column) -> Column:
    return F.nullif(text, F.lit("-"))


def _field(raw: DataFrame, w3c_name: str, column: str) -> Column:
    """A field under its W3C name or, failing that, under its record name."""
    if "fields" in raw.columns:
        found = [F.try_element_at("fields", F.lit(n)) for n in dict.fromkeys((w3c_name, column))]
    else:
        found = [F.col(f"`{n}`").cast("string") for n in dict.fromkeys((w3c_name, column)) if n in raw.columns]
    found = [_present(f) for f in found]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _extra(raw: DataFrame) -> Column:
    """Fields that are no record columns, under their raw names."""
    if "fields" in raw.columns:
        unknown = F.map_filter("fields", lambda name, _: ~F.array_contains(text_array(_KNOWN), name))
        return F.transform_values(unknown, lambda _, value: _present(value))
    names = [n for n in raw.columns if n not in _KNOWN]
    if not names:
        return F.lit(None).cast("map<string,string>")
    return F.create_map(*[part for n in names
                          for part in (F.lit(n), _present(F.col(f"`{n}`").cast("string")))])


def normalize(raw: DataFrame, zone: str = "UTC", carry: Sequence[str] = ()) -> DataFrame:
    """Records from raw rows, with the columns named in ``carry`` as they are.

    ``raw`` has ``log_file``, ``line_number``, ``raw_line`` and either a map ``fields`` (as the log
    sources give it) or one flat column per field. Derived columns are always computed afresh.
    """
    use_utc(raw.sparkSession)
    plain = raw.select(
        *[(_field(raw, w3c, column).try_cast("bigint") if column in INTEGER_COLUMNS
           else _field(raw, w3c, column)).alias(column) for w3c, column in W3C_COLUMNS.items()],
        *[F.col(c) if c in raw.columns else F.lit(None).alias(c) for c in PROVENANCE_COLUMNS],
        _extra(raw).alias("extra"), *carry,
    )
    decoded = plain.withColumns({
        "uri_path_decoded": url_decode(F.col("uri_path")),
        "uri_query_decoded": url_decode(F.col("uri_query")),
    })
    has_both = (F.length("uri_path") > 0) & (F.length("uri_query") > 0)
    return decoded.withColumns({
        "timestamp": event_time(F.col("date"), F.col("time"), zone),
        "url_original": join_url(F.col("uri_path"), F.col("uri_query")),
        # No escape sequence spans the question mark, so the parts decode independently.
        "url_decoded": F.when(has_both, F.concat("uri_path_decoded", F.lit("?"), "uri_query_decoded"))
                        .otherwise(F.col("uri_path_decoded")),
        "is_success_status": F.coalesce(F.col("status").between(200, 399), F.lit(False)),
        "is_error_status": F.coalesce(F.col("status") >= 400, F.lit(False)),
        "extension": file_extension(F.col("uri_path_decoded")),
    })
