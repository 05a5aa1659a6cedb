"""Window lengths: fixed durations and whole calendar months or years."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_PART = re.compile(r"(\d+)(mo|[smhdwy])")
MICROS_PER_DAY = 86_400_000_000


@dataclass(frozen=True)
class Duration:
    """Either months (calendar) or micros (fixed) is positive; weeks start on Monday."""

    months: int = 0
    micros: int = 0
    weeks: bool = False

    @classmethod
    def parse(cls, text: str) -> Duration:
        parts = _PART.findall(text)
        if not parts or "".join(n + u for n, u in parts) != text:
            raise ValueError(f"not a duration: {text!r}")
        months = sum(int(n) * {"mo": 1, "y": 12}.get(u, 0) for n, u in parts)
        micros = sum(int(n) * _MICROS.get(u, 0) for n, u in parts)
        if bool(months) == bool(micros) or (micros and len(parts) > 1):
            raise ValueError(f"a duration is whole months and years, or one positive fixed unit: {text!r}")
        return cls(months, micros, parts[0][1] == "w")

    @property
    def calendar(self) -> bool:
        return self.months > 0

    @property
    def text(self) -> str:
        """The shortest spelling: 24h is 1d, 12mo is 1y."""
        if self.calendar:
            return f"{self.months // 12}y" if self.months % 12 == 0 else f"{self.months}mo"
        if self.weeks:
            return f"{self.micros // _MICROS['w']}w"
        unit = next(u for u in "dhms" if self.micros % _MICROS[u] == 0)
        return f"{self.micros // _MICROS[unit]}{unit}"

    @property
    def sql(self) -> str:
        """An interval literal that Spark and DuckDB both read."""
        if self.calendar:
            return f"INTERVAL '{self.months}' MONTH"
        return f"INTERVAL '{self.micros // 1_000_000}' SECOND"

    def add(self, start: Column, times: int = 1) -> Column:
        return start + F.expr(f"{times} * {self.sql}")

    def floor(self, ts: Column) -> Column:
        """The start of the window that holds ts (a TIMESTAMP_NTZ)."""
        if self.calendar:
            month = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
            first = F.floor(month / self.months).cast("int") * self.months
            return F.add_months(F.lit("1970-01-01").cast("date"), first).cast("timestamp_ntz")
        seconds = f"{self.micros // 1_000_000} seconds"
        return (F.window(ts, seconds, seconds, "4 days") if self.weeks else F.window(ts, seconds)).getField("start").cast("timestamp_ntz")

    def floor_at(self, at: datetime) -> datetime:
        """floor() of a known time."""
        epoch = datetime(1970, 1, 1)
        if self.calendar:
            month = ((at.year - 1970) * 12 + at.month - 1) // self.months * self.months
            return datetime(1970 + month // 12, month % 12 + 1, 1)
        since = timedelta(days=4) if self.weeks else timedelta()
        micros = (at - epoch - since) // timedelta(microseconds=1)
        return epoch + since + timedelta(microseconds=micros // self.micros * self.micros)

    def bounds(self, anchor: Column, starts: bool) -> tuple[Column, Column]:
        """Start and end of the window at an anchor; a calendar anchor off a
        boundary has neither."""
        begin, end = (anchor, self.add(anchor)) if starts else (self.add(anchor, -1), anchor)
        if not self.calendar:
            return begin, end
        on = anchor == self.floor(anchor)
        return F.when(on, begin), F.when(on, end)

    def ticks(self, low: Column, high: Column) -> Column:
        """All window starts from low to high."""
        return F.sequence(low, high, F.expr(self.sql))


def model_days(ts: Column, origin: Column) -> Column:
    """Days since origin, as a fraction."""
    return F.timestamp_diff("MICROSECOND", origin, ts) / F.lit(float(MICROS_PER_DAY))


def as_utc(value: Column, kind: str) -> Column:
    """Strings (read as UTC unless they name a zone), dates and timestamps as
    TIMESTAMP_NTZ in UTC; the session's time zone must be UTC."""
    return (F.try_to_timestamp(value) if kind == "string" else value.cast("timestamp")).cast("timestamp_ntz")


#: Fixed list of accepted timestamp formats, tried in this order; a text with a
#: zone is converted to UTC.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd HH:mmXXX",
]


def strip_zone(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[Zz]$", ""), r"[+-]\d\d:\d\d$", "")


def parse_timestamp(text: Column) -> Column:
    """The first format that fits decides; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS]).cast("timestamp_ntz")
