"""Time expressions; every timestamp is zone-less UTC (``TIMESTAMP_NTZ``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text layouts accepted for day-first station stamps.
DAY_FIRST_FORMATS = ("dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy", "dd/MM/yyyy HH:mm:ss",
                     "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def hour_floor(c: Column) -> Column:
    return ntz(F.date_trunc("hour", c))


def parse_dayfirst(c: Column) -> Column:
    """Day-first text to timestamp; blank, '-' or unreadable text gives null."""
    text = F.trim(c)
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in DAY_FIRST_FORMATS]
    return ntz(F.when(text.isin("", "-"), None).otherwise(F.coalesce(*tries)))


def parse_utc(c: Column) -> Column:
    """ISO-like text to timestamp, null when unreadable."""
    return ntz(F.try_to_timestamp(F.trim(c)))


def add_hours(t: Column, hours: Column) -> Column:
    return t + F.make_dt_interval(F.lit(0), hours.cast("int"))


def hours_between(later: Column, earlier: Column) -> Column:
    """Signed hours, with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def local_time(t: Column, zone: str = "Asia/Kolkata") -> Column:
    return ntz(F.from_utc_timestamp(t.cast("timestamp"), zone))


def timeline_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:00:00")


def cycle_floor(t: Column, hours: int = 6) -> Column:
    """Start of the forecast cycle that holds ``t``."""
    h = F.hour(t)
    day = ntz(F.date_trunc("day", t))
    return add_hours(day, h - h % hours)


def run_id(t: Column, source: str) -> Column:
    """Deterministic run name of one poll (station, fire) or forecast cycle."""
    if source == "gfs":
        c = cycle_floor(t)
        return F.concat(F.lit("gfs."), F.date_format(c, "yyyy-MM-dd"), F.lit("."), F.date_format(c, "HH"), F.lit("z"))
    return F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("T"), F.date_format(t, "HHmm"), F.lit(f"Z-{source}-poll"))


def iso_day(c: Column) -> Column:
    """Year-month-day text, padded or not, to a date; other text gives null."""
    text = F.trim(c)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), text.try_cast("date"))
