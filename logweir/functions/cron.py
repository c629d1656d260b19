"""Cron expressions of six fields: second, minute, hour, day of month, month, day of week."""

from __future__ import annotations

import calendar
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

# Bounds of the fields, names, and shorthands.
BOUNDS = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
MONTHS = {m.upper(): i for i, m in enumerate(calendar.month_abbr) if m}
DAYS = {d: i for i, d in enumerate("SUN MON TUE WED THU FRI SAT".split())}
SHORT = {"@yearly": "0 0 0 1 1 *", "@annually": "0 0 0 1 1 *", "@monthly": "0 0 0 1 * *", "@weekly": "0 0 0 * * 0", "@daily": "0 0 0 * * *", "@midnight": "0 0 0 * * *", "@hourly": "0 0 * * * *"}


class Cron:
    def __init__(self, text: str, zone: str = "UTC"):
        fields = SHORT.get(text.strip(), text).split()
        if len(fields) != 6:
            raise ValueError(f"six fields are needed: {text!r}")
        self.zone, self.last_day, self.weekday_n = ZoneInfo(zone), False, None
        if fields[3] == "L":
            self.last_day, fields[3] = True, "*"
        if "#" in fields[5]:
            day, n = fields[5].split("#")
            self.weekday_n, fields[5] = int(n), day
        self.sets = [self._field(f, *b, names) for f, b, names in zip(fields, BOUNDS, ({}, {}, {}, {}, MONTHS, DAYS))]
        self.sets[5] = {d % 7 for d in self.sets[5]}

    @staticmethod
    def _field(text: str, low: int, high: int, names: dict[str, int]) -> set[int]:
        def number(x: str) -> int:
            n = names.get(x.upper())
            n = int(x) if n is None else n
            if not low <= n <= high:
                raise ValueError(f"{n} is not in {low}-{high}")
            return n

        out: set[int] = set()
        for part in text.split(","):
            span, _, every = part.partition("/")
            if span in ("*", "?"):
                a, b = low, high
            elif "-" in span:
                a, b = map(number, span.split("-"))
            else:
                a = number(span)
                b = high if every else a
            if a > b or every and int(every) < 1:
                raise ValueError(part)
            out.update(range(a, b + 1, int(every or 1)))
        return out

    def _day(self, t: datetime) -> bool:
        if t.month not in self.sets[4] or t.day not in self.sets[3] or (t.weekday() + 1) % 7 not in self.sets[5]:
            return False
        if self.last_day and t.day != calendar.monthrange(t.year, t.month)[1]:
            return False
        return self.weekday_n is None or (t.day - 1) // 7 + 1 == self.weekday_n

    def next_fire(self, after: datetime) -> datetime | None:
        """The first time strictly after an instant; None if there is none within eight years."""
        t = after.astimezone(self.zone).replace(microsecond=0, tzinfo=None) + timedelta(seconds=1)
        end = t + timedelta(days=366 * 8)
        while t < end:
            if not self._day(t):
                t = datetime(t.year, t.month, t.day) + timedelta(days=1)
            elif t.hour not in self.sets[2]:
                t = t.replace(minute=0, second=0) + timedelta(hours=1)
            elif t.minute not in self.sets[1]:
                t = t.replace(second=0) + timedelta(minutes=1)
            elif t.second not in self.sets[0]:
                t += timedelta(seconds=1)
            else:
                found = t.replace(tzinfo=self.zone)
                if found.astimezone(ZoneInfo("UTC")).astimezone(self.zone).replace(tzinfo=None) == t and found > after:  # skipped hours don't fire
                    return found
                t += timedelta(seconds=1)
        return None
