"""Time bounds as predicates over lexically ordered timestamps."""

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_INSTANT = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z")


def _is_day(bound: str) -> bool:
    return len(bound) == 10


def _epoch_ms(bound: str) -> int:
    if _is_day(bound):
        parsed = datetime.combine(date.fromisoformat(bound), datetime.min.time(), timezone.utc)
        return int(parsed.timestamp()) * 1000
    whole = datetime.fromisoformat(bound[:19]).replace(tzinfo=timezone.utc)
    return int(whole.timestamp()) * 1000 + int(bound[20:23])


@dataclass(frozen=True)
class TimeWindow:
    """Inclusive bounds; each a bare day or a millisecond UTC instant."""

    since: str = ""
    until: str = ""

    def __post_init__(self):
        for label, bound in (("since", self.since), ("until", self.until)):
            if bound and not (_DAY.fullmatch(bound) or _INSTANT.fullmatch(bound)):
                raise ValueError(
                    f"{label} accepts YYYY-MM-DD or YYYY-MM-DDTHH:MM:SS.sssZ, got {bound!r}"
                )

    @property
    def active(self) -> bool:
        return bool(self.since or self.until)

    def includes(self, ts: Column) -> Column:
        """Plain comparisons, so a Parquet scan can skip row groups by them.

        An empty timestamp is outside any active window; a NULL one yields
        NULL, which no filter keeps and no conditional count counts.
        """
        if not self.active:
            return F.lit(True)
        inside = ts != ""
        if self.since:
            inside = inside & (ts >= self.since)
        if self.until:
            # The highest code point stands for "anything later that day".
            inside = inside & (ts <= self.until + ("\U0010ffff" if _is_day(self.until) else ""))
        return inside

    def includes_nanos(self, ts: Column) -> Column:
        """The same bounds against nine-digit UTC strings."""
        if not self.active:
            return F.lit(True)
        inside = ts != ""
        if self.since:
            low = f"{self.since}T00:00:00" if _is_day(self.since) else self.since[:19]
            fraction = "000" if _is_day(self.since) else self.since[20:23]
            inside = inside & (ts >= f"{low}.{fraction}000000Z")
        if self.until:
            if _is_day(self.until):
                high = f"{self.until}T23:59:59.999999999Z"
            else:
                high = f"{self.until[:23]}000000Z"
            inside = inside & (ts <= high)
        return inside

    def includes_millis(self, ms: Column) -> Column:
        """The same bounds against integer milliseconds since the epoch."""
        if not self.active:
            return F.lit(True)
        inside = F.lit(True)
        if self.since:
            inside = inside & (ms >= _epoch_ms(self.since))
        if self.until:
            if _is_day(self.until):
                next_day = date.fromisoformat(self.until) + timedelta(days=1)
                inside = inside & (ms < _epoch_ms(next_day.isoformat()))
            else:
                inside = inside & (ms <= _epoch_ms(self.until))
        return inside


ALWAYS = TimeWindow()
