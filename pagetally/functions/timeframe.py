"""Time range of a report, and time truncation in a time zone."""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetally.params import ReportParams


def clean_timezone(name: str) -> str:
    return "GMT" if name in ("", "undefined") else name


def local_midnight(day: date, tz: str) -> datetime:
    """The instant (naive UTC) at which ``day`` begins in ``tz``."""
    local = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(clean_timezone(tz)))
    return local.astimezone(timezone.utc).replace(tzinfo=None)


def local_instant(text: str, tz: str) -> datetime:
    """The instant (naive UTC) of a local date or date and time in ISO form."""
    local = datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(clean_timezone(tz)))
    return local.astimezone(timezone.utc).replace(tzinfo=None)


def today(p: ReportParams) -> date:
    """Calendar day of ``as_of`` in the report's time zone."""
    zone = ZoneInfo(clean_timezone(p.timezone))
    return p.as_of.replace(tzinfo=timezone.utc).astimezone(zone).date()


@dataclass(frozen=True)
class TimeRange:
    """Instants in naive UTC. ``lo <= time < hi``, or ``<= hi`` when ``closed``."""

    lo: datetime
    hi: datetime
    closed: bool = False

    def before(self) -> "TimeRange":
        """The equally long range that ends where this one begins."""
        return TimeRange(self.lo - (self.hi - self.lo), self.lo)

    def contains(self, time: Column) -> Column:
        upper = time <= as_instant(self.hi) if self.closed else time < as_instant(self.hi)
        return (time >= as_instant(self.lo)) & upper


def as_instant(moment: datetime) -> Column:
    """Timestamp literal for a naive UTC moment, independent of the driver's local zone."""
    return F.lit(moment.replace(tzinfo=timezone.utc))


def time_range(p: ReportParams, scale: int = 1, closed: bool = False) -> TimeRange:
    """Resolve offset/interval or start/end dates to two instants.

    Offset and interval count 24-hour days (times ``scale``) back from today's midnight in the
    report's zone. An open range also ends at ``as_of``; the closed form is that of the older scan.
    """
    midnight = local_midnight(today(p), p.timezone)
    if p.offset >= 0:
        hi = midnight - timedelta(days=p.offset * scale)
    else:
        hi = local_midnight(date.fromisoformat(p.enddate), p.timezone)
        hi += timedelta(days=0 if closed else 1)
    if p.interval >= 0:
        lo = midnight - timedelta(days=(max(p.offset, 0) + p.interval) * scale)
    else:
        lo = local_midnight(date.fromisoformat(p.startdate), p.timezone)
    if not closed:
        hi = min(hi, p.as_of)
    return TimeRange(lo, hi, closed)


def to_local(time: Column, tz: str) -> Column:
    """Wall-clock reading of an instant in ``tz``; the session zone is UTC."""
    tz = clean_timezone(tz)
    return time if tz == "UTC" else F.from_utc_timestamp(time, tz)


def from_local(wall: Column, tz: str) -> Column:
    tz = clean_timezone(tz)
    return wall if tz == "UTC" else F.to_utc_timestamp(wall, tz)


def truncate(time: Column, unit: str, tz: str = "UTC") -> Column:
    """Start of the hour/day/week(Monday)/month/quarter/year around ``time`` in ``tz``.

    An hour begins where its local minutes do; taken off the instant, not off the wall clock, on which a repeated hour
    reads the same twice.
    """
    if unit == "hour":
        return F.timestamp_micros(F.unix_micros(time) - F.pmod(F.unix_micros(to_local(time, tz)), F.lit(3_600_000_000)))
    return from_local(F.date_trunc(unit, to_local(time, tz)), tz)


def instant_text(time: Column, tz: str = "UTC") -> Column:
    """``2024-01-01 00:00:00+00``: wall clock and offset, minutes of the offset only if not 0."""
    wall = to_local(time, tz)
    shift = ((F.unix_micros(wall) - F.unix_micros(time)) / 60_000_000).cast("int")
    minutes = F.abs(shift) % 60
    return F.concat(
        F.date_format(wall, "yyyy-MM-dd HH:mm:ss"),
        F.when(shift < 0, "-").otherwise("+"),
        F.lpad(F.floor(F.abs(shift) / 60).cast("string"), 2, "0"),
        F.when(minutes > 0, F.concat(F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))).otherwise(""),
    )


def iso_text(time: Column) -> Column:
    """``2024-01-01T00:00:00+00:00`` in UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssxxx")


def month_label(time: Column) -> Column:
    """``2024-Jan``."""
    return F.date_format(time, "yyyy-MMM")
