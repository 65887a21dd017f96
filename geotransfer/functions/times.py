"""Mission-epoch and millisecond-epoch times (UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from geotransfer.functions.numeric import _col

_MISSION_MICROS = 1_514_764_800_000_000  # 2018-01-01T00:00:00Z


def mission_time(seconds) -> Column:
    """Seconds since 2018-01-01 as a timestamp, kept to the microsecond."""
    micros = F.round(_col(seconds) * F.lit(1e6)).cast("long") + F.lit(_MISSION_MICROS)
    return F.timestamp_micros(micros)


def iso_text(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def millis_time(ms) -> Column:
    """Millisecond epoch as a timestamp, only for positive values."""
    v = _col(ms)
    return F.when(v > 0, F.timestamp_millis(v))


def in_calendar_year(ts, year) -> Column:
    """Half-open calendar-year test; on a literal year it reaches the Parquet scan."""
    y = F.lit(year) if isinstance(year, int) else year
    return ((_col(ts) >= F.make_date(y, F.lit(1), F.lit(1)).cast("timestamp"))
            & (_col(ts) < F.make_date(y + F.lit(1), F.lit(1), F.lit(1)).cast("timestamp")))
