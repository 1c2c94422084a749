"""The clocks of an observation, at the API's edge. In tables they are BIGINT nanoseconds since 1970 UTC."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def to_ns(moment: datetime) -> int:
    if moment.tzinfo is None:
        raise ValueError("a moment needs a time zone")
    d = moment - _EPOCH
    return ((d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds) * 1000


def from_ns(ns: int) -> datetime:
    """Microseconds are the finest that datetime holds; the rest is cut off."""
    return _EPOCH + timedelta(microseconds=ns // 1000)


@dataclass(frozen=True, order=False)
class _Clock:
    ns: int

    @classmethod
    def at(cls, moment: datetime):
        return cls(to_ns(moment))

    def as_datetime(self) -> datetime:
        return from_ns(self.ns)

    def _same(self, other: object) -> int:
        if type(other) is not type(self):
            raise TypeError(f"{type(self).__name__} and {type(other).__name__} are different clocks")
        return other.ns

    def __lt__(self, other: object) -> bool:
        return self.ns < self._same(other)

    def __le__(self, other: object) -> bool:
        return self.ns <= self._same(other)

    def __gt__(self, other: object) -> bool:
        return self.ns > self._same(other)

    def __ge__(self, other: object) -> bool:
        return self.ns >= self._same(other)


class EventTime(_Clock):
    """When something happened."""


class IngestTime(_Clock):
    """When a row was stored; for audits only."""


class AsOf(_Clock):
    """A cut on the knowledge axis."""

    @classmethod
    def from_knowledge_time(cls, known: KnowledgeTime) -> AsOf:
        return cls(known.ns)

    def less_embargo(self, embargo: timedelta) -> AsOf:
        if embargo < timedelta(0):
            raise ValueError("an embargo can't be negative")
        return AsOf(self.ns - (embargo // timedelta(microseconds=1)) * 1000)


class KnowledgeTime(_Clock):
    """When something became knowable."""

    def knowable(self, as_of: AsOf) -> bool:
        if not isinstance(as_of, AsOf):
            raise TypeError("knowable takes an AsOf")
        return self.ns <= as_of.ns


def publication_lag(event: EventTime, known: KnowledgeTime) -> timedelta:
    """May be negative: schedules are known before they happen."""
    return timedelta(microseconds=(known.ns - event.ns) // 1000)
