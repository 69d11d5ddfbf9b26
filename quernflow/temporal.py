"""Date templates: `{{ name }}`, `{{ name + n }}` and `{{ name - n }}`, rendered in UTC for one execution time."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

_MARK = re.compile(r"\{\{(.*?)\}\}", re.DOTALL)
_BODY = re.compile(r"\s*(\w+)\s*([+-])?\s*(\d+)?\s*", re.ASCII)


class TemplateError(ValueError):
    """A template that cannot be rendered."""


def add_months(at: datetime, n: int) -> datetime:
    """Calendar months later; a day that the month lacks becomes its last."""
    months = at.year * 12 + at.month - 1 + n
    year, month = divmod(months, 12)
    return at.replace(year=year, month=month + 1, day=min(at.day, calendar.monthrange(year, month + 1)[1]))


def _steps(unit: str, at: datetime, n: int) -> datetime:
    if unit == "month":
        return add_months(at, n)
    if unit in ("quarter", "year"):
        return add_months(at, n * (3 if unit == "quarter" else 12))
    return at + timedelta(**{unit + "s": n})


#: Name: the unit that +n and -n count, and the text of a moment.
_DAY = "%Y%m%d"
VARIABLES = {
    "today": ("day", lambda t: t.strftime(_DAY)),
    "yesterday": ("day", lambda t: (t - timedelta(days=1)).strftime(_DAY)),
    "tomorrow": ("day", lambda t: (t + timedelta(days=1)).strftime(_DAY)),
    "iso_date": ("day", lambda t: t.strftime("%Y-%m-%d")),
    "iso_datetime": ("second", lambda t: t.strftime("%Y-%m-%dT%H:%M:%S")),
    "iso_timestamp": ("second", lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")),
    "year_month": ("month", lambda t: t.strftime("%Y%m")),
    "current_quarter": ("quarter", lambda t: str((t.month + 2) // 3)),
    "current_dow": ("day", lambda t: str(t.isoweekday())),
    "current_doy": ("day", lambda t: str(t.timetuple().tm_yday)),
    "current_week": ("week", lambda t: str(t.isocalendar().week)),
    "week_pad": ("week", lambda t: f"{t.isocalendar().week:02d}"),
    "epoch_seconds": ("second", lambda t: str(int(t.timestamp()))),
    "epoch_millis": ("millisecond", lambda t: str(int(t.timestamp()) * 1000 + t.microsecond // 1000)),
}
for _unit in ("year", "month", "day", "hour", "minute", "second"):
    VARIABLES[_unit] = VARIABLES[f"current_{_unit}"] = (_unit, lambda t, u=_unit: str(getattr(t, u)))
    if _unit != "year":
        VARIABLES[f"{_unit}_pad"] = (_unit, lambda t, u=_unit: f"{getattr(t, u):02d}")


@dataclass(frozen=True)
class TemporalVariables:
    """The moment that templates refer to; the present one by default."""

    execution_time: datetime = field(default_factory=lambda: datetime.now(UTC))

    def render(self, text: str) -> str:
        at = self.execution_time
        at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)

        def one(m: re.Match) -> str:
            body = _BODY.fullmatch(m[1])
            name = body and body[1]
            if not body or name not in VARIABLES:
                raise TemplateError(f"Unknown template variable '{m[1].strip()}'. Available: {', '.join(sorted(VARIABLES))}")
            if bool(body[2]) != bool(body[3]):
                raise TemplateError(f"Incomplete offset in template '{m[0]}'")
            unit, show = VARIABLES[name]
            n = int(body[3] or 0) * (-1 if body[2] == "-" else 1)
            return show(_steps(unit, at, n))

        return _MARK.sub(one, text)
