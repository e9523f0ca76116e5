"""The base predicates: message kinds, and the scope of a query."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.timeutil import ZONE

KINDS = ("text_turn", "segmentable_text", "visible_message", "reaction_add", "reaction_remove", "object_message", "all_row")


def kind_filter(kind: str, amt: str = "amt", text: str = "text") -> Column:
    a = F.col(amt)
    plain = a.isNull() | (a == 0)
    match kind:
        case "text_turn":
            return plain
        case "segmentable_text":
            return plain & F.col(text).isNotNull() & (F.col(text) != "")
        case "visible_message" | "browsable_message":
            return a.isNull() | (a < 2000)
        case "reaction_add":
            return (a >= 2000) & (a < 3000)
        case "reaction_remove":
            return (a >= 3000) & (a < 4000)
        case "object_message":
            return (a > 0) & (a < 2000)
        case "all_row":
            return F.lit(True)
    raise ValueError(f"no such kind: {kind}")


def _midnight(day: str, zone: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(zone)).astimezone(UTC).timestamp())


def day_start(day: str, zone: str = ZONE) -> int:
    """Epoch seconds at which a local day begins."""
    return _midnight(day, zone)


def day_end(day: str, zone: str = ZONE) -> int:
    """Epoch seconds at which the next local day begins; days have 23 to 25 hours."""
    return _midnight((date.fromisoformat(day) + timedelta(days=1)).isoformat(), zone)


def month_bounds(month: str, zone: str = ZONE) -> tuple[int, int]:
    year, m = map(int, month.split("-"))
    following = f"{year + m // 12:04d}-{m % 12 + 1:02d}-01"
    return _midnight(f"{month}-01", zone), _midnight(following, zone)


@dataclass(frozen=True)
class Scope:
    """A date range in local days and a sender; every part may be absent."""

    from_: str | None = None
    to: str | None = None
    sender: str = "both"
    phase: int | None = None

    @classmethod
    def parse(cls, raw: dict) -> Scope:
        """Lenient: dates that aren't dates, senders and phases that aren't known are left out."""
        day = lambda x: x if isinstance(x, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) else None
        phase = str(raw.get("phase", "")).strip().strip('"')
        sender = raw.get("sender")
        return cls(day(raw.get("from")), day(raw.get("to")), sender if sender in ("me", "them", "both") else "both", int(phase) if phase.isdigit() else None)

    def within(self, phases: dict[int, tuple[str, str]]) -> Scope:
        """With the phase's months as bounds, where there are none of its own."""
        if self.phase is None or self.phase not in phases:
            return self
        start, end = phases[self.phase]
        first, last = f"{start}-01", (date.fromisoformat(f"{_next(end)}-01") - timedelta(days=1)).isoformat()
        return Scope(self.from_ or first, self.to or last, self.sender, self.phase)

    def apply(self, df: DataFrame, ts: str = "ts", sender: str = "is_from_me") -> DataFrame:
        """Filters on epoch literals, which reach the scan."""
        if self.from_:
            df = df.filter(F.col(ts) >= day_start(self.from_))
        if self.to:
            df = df.filter(F.col(ts) < day_end(self.to))
        if self.sender != "both":
            df = df.filter(F.col(sender) == int(self.sender == "me"))
        return df


def _next(month: str) -> str:
    year, m = map(int, month.split("-"))
    return f"{year + m // 12:04d}-{m % 12 + 1:02d}"
