"""Calendar and elapsed-time Column expressions (all JVM-side)."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hour(ts) -> Column:
    return F.hour(_c(ts))


def weekday(ts) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(_c(ts))


def is_weekend(ts) -> Column:
    return (F.weekday(_c(ts)) >= 5).cast("int")


def epoch_seconds(ts) -> Column:
    """Seconds since epoch as double (NTZ read as UTC wall clock)."""
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1_000_000.0)


def epoch_micros(ts) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def whole_days_between(later, earlier) -> Column:
    """floor(elapsed / 24 h), the ``timedelta.days`` of the difference."""
    return F.floor((epoch_micros(later) - epoch_micros(earlier)) / F.lit(86_400_000_000)).cast("long")


def hour_bin(h) -> Column:
    """Right-closed bins (0,6],(6,12],(12,18],(18,24] -> 0..3; hour 0 -> null."""
    h = _c(h)
    return (F.when((h > 0) & (h <= 6), 0).when((h > 6) & (h <= 12), 1)
             .when((h > 12) & (h <= 18), 2).when((h > 18) & (h <= 24), 3))


def cyc_sin(x, period: float) -> Column:
    return F.sin(F.lit(2 * math.pi) * _c(x) / F.lit(float(period)))


def cyc_cos(x, period: float) -> Column:
    return F.cos(F.lit(2 * math.pi) * _c(x) / F.lit(float(period)))


def month_key(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def day_key(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def ts_text(ts) -> Column:
    """Timestamp as text, micro precision, for oracle-comparable output."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def ntz_literal(text: str) -> Column:
    """A wall-clock timestamp constant parsed from text: independent of the
    session and process time zones."""
    return F.lit(text.replace("T", " ")).cast("timestamp_ntz")
