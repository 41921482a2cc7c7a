"""Time expressions. Sessions run with ``spark.sql.session.timeZone = UTC``."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def use_utc(spark: SparkSession) -> None:
    """Make timestamps render in UTC, as every output of this package promises."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def offset_seconds(zone: str) -> int:
    """Seconds east of UTC for ``UTC``, ``Z``, ``+HH``, ``+HHMM`` or ``+HH:MM`` (sign optional)."""
    text = zone.strip()
    if text.upper() in ("", "Z", "UTC"):
        return 0
    parts = re.fullmatch(r"([+-]?)(\d\d)(\d\d)?", text.replace(":", ""), re.ASCII)
    if not parts:
        raise ValueError(f"{zone!r} is no offset from UTC, such as +02:00 or Z")
    hours, minutes = int(parts[2]), int(parts[3] or 0)
    if hours > 14 or minutes > 59:
        raise ValueError(f"{zone!r} is farther from UTC than any place")
    return (-1 if parts[1] == "-" else 1) * (hours * 3600 + minutes * 60)


def event_time(date: Column, time: Column, zone: str = "UTC") -> Column:
    """UTC timestamp of W3C date and time text written in a fixed-offset zone; NULL if malformed."""
    well_formed = (date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z") & time.rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}\z"))
    stamp = F.when(well_formed, F.concat(date, F.lit(" "), time, F.lit("+00:00"))).try_cast("timestamp")
    shift = offset_seconds(zone)
    return F.timestamp_seconds(F.unix_seconds(stamp) - F.lit(shift)) if shift else stamp


def iso_text(stamp: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` text of a timestamp."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")
