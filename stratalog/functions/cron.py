"""Schedule expressions: five fields, six with seconds in front, or a descriptor."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from ..errors import InvalidOptions

_DESCRIPTORS = {"@yearly", "@annually", "@monthly", "@weekly", "@daily", "@midnight", "@hourly"}
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())}
#: Name, lowest and highest value of the five fields, and names that stand for values.
_FIELDS = (("minute", 0, 59, {}), ("hour", 0, 23, {}), ("day", 1, 31, {}), ("month", 1, 12, _MONTHS), ("weekday", 0, 6, _DAYS))
_SECONDS = ("second", 0, 59, {})
_DURATION = re.compile(r"@every\s+(\d+(\.\d+)?(ns|us|µs|ms|s|m|h))+")


def check_cron(expression: str) -> None:
    """Raise ``InvalidOptions`` unless the expression is a schedule."""
    text = expression.strip()
    text = re.sub(r"^(CRON_)?TZ=\S+\s+", "", text)
    if text.startswith("@"):
        if text.lower() in _DESCRIPTORS or _DURATION.fullmatch(text):
            return
        raise InvalidOptions(f"unknown schedule {expression!r}")
    parts = text.split()
    if len(parts) not in (5, 6):
        raise InvalidOptions(f"a schedule has five or six fields, not {len(parts)}")
    for part, (name, low, high, names) in zip(parts, _FIELDS if len(parts) == 5 else (_SECONDS, *_FIELDS), strict=True):
        for item in part.split(","):
            _check_item(item, name, low, high, names)


def _check_item(item: str, name: str, low: int, high: int, names: dict[str, int]) -> None:
    span, _, step = item.partition("/")
    if "/" in item and not (step.isdigit() and int(step) > 0):
        raise InvalidOptions(f"bad step in {name}: {item!r}")
    if span in ("*", "?"):
        return
    ends = [names.get(x.lower(), x) for x in span.split("-")]
    if len(ends) > 2 or not all(str(x).isdigit() for x in ends):
        raise InvalidOptions(f"bad {name}: {item!r}")
    values = [int(x) for x in ends]
    if values != sorted(values) or values[0] < low or values[-1] > high:
        raise InvalidOptions(f"{name} out of range: {item!r}")


#: Nanoseconds of the units of durations, and the schedules that descriptors stand for (fixed values).
_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_MEANT = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}


def _values(field: str, low: int, high: int, names: dict[str, int]) -> set[int]:
    out: set[int] = set()
    for item in field.split(","):
        span, _, step = item.partition("/")
        ends = [low, high] if span in ("*", "?") else [int(names.get(x.lower(), x)) for x in span.split("-")]
        last = ends[-1] if len(ends) > 1 or not step else high
        out.update(range(ends[0], last + 1, int(step or 1)))
    return out


def next_time(expression: str, after_ns: int) -> int | None:
    """The first time of a schedule after ``after_ns``, in nanoseconds; UTC without a zone in front. None where it has none within eight years.

    Where both the day of the month and the weekday are restricted, a day that meets either counts.
    """
    check_cron(expression)
    text, zone = expression.strip(), timezone.utc
    if found := re.match(r"^(?:CRON_)?TZ=(\S+)\s+", text):
        zone, text = ZoneInfo(found[1]), text[found.end() :]
    if text.startswith("@every"):
        return after_ns + round(sum(float(n) * _UNITS[u] for n, _, u in re.findall(r"(\d+(\.\d+)?)(ns|us|µs|ms|s|m|h)", text)))
    parts = _MEANT.get(text.lower(), text).split()
    fields = [_values(p, low, high, names) for p, (_, low, high, names) in zip(parts if len(parts) == 6 else ["0", *parts], (_SECONDS, *_FIELDS), strict=True)]
    seconds, minutes, hours, days, months, weekdays = map(sorted, fields)
    free = [p.split("/")[0] in ("*", "?") for p in (parts[-3], parts[-1])]
    start = datetime.fromtimestamp(after_ns // 10**9, zone) + timedelta(seconds=1)
    for k in range(8 * 366):
        day = start.date() + timedelta(days=k)
        by_day, by_week = day.day in days, day.isoweekday() % 7 in weekdays
        if day.month not in months or not (by_day and by_week if any(free) else by_day or by_week):
            continue
        for h in hours:
            for m in minutes:
                for s in seconds:
                    at = datetime(day.year, day.month, day.day, h, m, s, tzinfo=zone)
                    if at >= start:
                        return int(at.timestamp()) * 10**9
    return None
