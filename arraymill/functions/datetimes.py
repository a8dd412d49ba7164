"""Calendar parts, differences and ISO text of UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO text of a UTC time (fixed form).
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def parse(text: Column) -> Column:
    """Timestamp of an ISO text that ends in Z; other texts raise."""
    return F.when(text.rlike(ISO), F.to_timestamp(text)).otherwise(F.raise_error(F.concat(F.lit("no ISO time: "), text)).cast("timestamp"))


def to_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parts(ts: Column) -> dict[str, Column]:
    micros = F.unix_micros(ts)
    return {"year": F.year(ts), "month": F.month(ts), "day": F.day(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts), "fraction": F.pmod(micros, F.lit(1_000_000)) / 1e6}


def build(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, fraction: Column | None = None) -> Column:
    return F.make_timestamp(year, month, day, hour, minute, second + (F.lit(0.0) if fraction is None else fraction))


def seconds_between(a: Column, b: Column) -> Column:
    """a - b in seconds."""
    return (F.unix_micros(a) - F.unix_micros(b)) / 1e6


def now() -> Column:
    return F.current_timestamp()
