"""Common report parameters."""
from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from datetime import datetime, timezone


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class ReportParams:
    """Arguments shared by the reports. ``-`` switches a filter off.

    ``as_of`` is the instant every "now" in a report refers to, as naive UTC; it is fixed once
    here so that a plan holds literals and can be repeated.
    A negative ``interval``/``offset`` makes ``startdate``/``enddate`` take effect.
    """

    as_of: datetime = field(default_factory=_utc_now)
    url: str = "-"
    interval: int = 30
    offset: int = 0
    startdate: str = "-"
    enddate: str = "-"
    timezone: str = "UTC"
    device: str = "all"
    limit: int = 30
    checkpoint: str = "-"
    source: str = "-"
    sources: str = "-"
    targets: str = "-"
    domainkey: str | None = None

    @classmethod
    def from_mapping(cls, values: dict) -> "ReportParams":
        """Build parameters from loosely typed values, e.g. a parsed query string.

        Numbers may come as text; a list value means that a name was given twice and is refused;
        names that are not parameters are ignored.
        """
        types = {f.name: f.type for f in dataclasses.fields(cls)}
        kept = {}
        for name, value in values.items():
            if isinstance(value, (list, tuple)):
                raise ValueError(f"parameter {name!r} given more than once")
            if name not in types:
                continue
            if types[name] == "int":
                value = int(value)
            elif types[name] == "datetime" and isinstance(value, str):
                value = datetime.fromisoformat(value)
            kept[name] = value
        return cls(**kept)

    def replace(self, **changes) -> "ReportParams":
        return dataclasses.replace(self, **changes)
