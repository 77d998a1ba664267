"""Time predicates; calendar ones become half-open ranges of literals, which reach the scan as filters."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from .expressions import Cond


class Time:
    """Bounds are computed in `zone` and compared in UTC; columns without a zone hold UTC."""

    def __init__(self, name: str, zone: str = "UTC", now: dt.datetime | None = None):
        self.name, self.zone, self._now = name, ZoneInfo(zone), now

    def _utc(self, t: dt.datetime) -> dt.datetime:
        t = t if t.tzinfo else t.replace(tzinfo=self.zone)
        return t.astimezone(dt.timezone.utc).replace(tzinfo=None)

    def _lit(self, t: dt.datetime):
        return F.to_timestamp_ntz(F.lit(self._utc(t).isoformat(sep=" ")))

    def _range(self, start: dt.datetime, end: dt.datetime) -> Cond:
        return Cond(lambda r: (r(self.name) >= self._lit(start)) & (r(self.name) < self._lit(end)))

    def after(self, t: dt.datetime) -> Cond:
        return Cond(lambda r: r(self.name) > self._lit(t))

    def before(self, t: dt.datetime) -> Cond:
        return Cond(lambda r: r(self.name) < self._lit(t))

    def from_(self, t: dt.datetime) -> Cond:
        return Cond(lambda r: r(self.name) >= self._lit(t))

    def until(self, t: dt.datetime) -> Cond:
        return Cond(lambda r: r(self.name) <= self._lit(t))

    def between(self, start: dt.datetime, end: dt.datetime) -> Cond:
        return Cond(lambda r: r(self.name).between(self._lit(start), self._lit(end)))

    def not_between(self, start: dt.datetime, end: dt.datetime) -> Cond:
        return ~self.between(start, end)

    def in_range(self, start: dt.datetime, end: dt.datetime) -> Cond:
        return self._range(start, end)

    def on_date(self, day: dt.date) -> Cond:
        start = dt.datetime(day.year, day.month, day.day)
        return self._range(start, start + dt.timedelta(days=1))

    def in_month(self, year: int, month: int) -> Cond:
        return self._range(dt.datetime(year, month, 1), dt.datetime(year + month // 12, month % 12 + 1, 1))

    def in_year(self, year: int) -> Cond:
        return self._range(dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1))

    def _today(self) -> dt.datetime:
        now = self._now.astimezone(self.zone) if self._now else dt.datetime.now(self.zone)
        return dt.datetime(now.year, now.month, now.day)

    def today(self) -> Cond:
        return self.on_date(self._today().date())

    def this_month(self) -> Cond:
        return self.in_month(self._today().year, self._today().month)

    def this_year(self) -> Cond:
        return self.in_year(self._today().year)

    def last_days(self, n: int) -> Cond:
        """Today and the days before it, n in all (1 at least)."""
        end = self._today() + dt.timedelta(days=1)
        return self._range(end - dt.timedelta(days=max(1, n)), end)


def time(name: str, zone: str = "UTC", now: dt.datetime | None = None) -> Time:
    return Time(name, zone, now)
