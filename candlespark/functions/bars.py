"""Column rules for bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def invalid_reason() -> Column:
    """Why a bar is impossible (first rule that it breaks), or null."""
    rule = F.when(F.col("ts").isNull(), F.lit("missing timestamp"))
    for p in PRICES:
        rule = rule.when(F.col(p).isNull() | F.isnan(p) | (F.col(p) <= 0), F.lit(f"{p} not positive"))
    rule = rule.when(F.col("high") < F.col("low"), F.lit("high below low"))
    rule = rule.when((F.col("high") < F.col("open")) | (F.col("high") < F.col("close")), F.lit("high below open or close"))
    rule = rule.when((F.col("low") > F.col("open")) | (F.col("low") > F.col("close")), F.lit("low above open or close"))
    rule = rule.when(F.col("adj_close") <= 0, F.lit("adjusted close not positive"))
    return rule.when(F.col("volume") < 0, F.lit("negative volume"))


def positive(c: Column) -> Column:
    """``c`` where positive, else null."""
    return F.when(c > 0, c)


def percent_change(open_: Column, close: Column) -> Column:
    """Change in percent; null where the open isn't positive."""
    return F.when(open_ > 0, (close - open_) / open_ * 100)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a UTC TIMESTAMP_NTZ, by interval arithmetic."""
    from candlespark.functions.calendar import seconds_between

    return seconds_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a UTC TIMESTAMP_NTZ, by interval arithmetic."""
    d = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), d).cast("long")
    seconds = part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), d) * 1_000_000).cast("long")


def as_instant(ts: Column) -> Column:
    """A UTC TIMESTAMP_NTZ as a TIMESTAMP (what watermarks take), whatever the session zone."""
    return F.timestamp_micros(epoch_micros(ts))


def from_epoch_or_text(c: Column) -> Column:
    """UTC instant of a scalar that holds epoch seconds or an RFC 3339 text; null for others."""
    text = F.trim(c)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    number = F.when(text.rlike(r"^-?\d+$"), text.cast("long"))
    seconds = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), number.cast("decimal(18,6)"))
    # an RFC 3339 text is split into wall clock and offset, so no session zone takes part
    shape = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    good = text.rlike(shape)
    wall = F.concat(F.regexp_extract(text, shape, 1), F.lit(" "), F.regexp_extract(text, shape, 2), F.regexp_extract(text, shape, 3))
    zone = F.regexp_replace(F.regexp_extract(text, shape, 4), "^[Zz]$", "+00:00")
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    offset = sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))
    at = wall.try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), offset, F.lit(0))
    return F.when(number.isNotNull(), seconds).when(good, at)
