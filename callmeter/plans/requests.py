"""The parameters of a snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

DEFAULT_DAYS, MOST_DAYS = 30, 366


@dataclass(frozen=True)
class Request:
    workspace: str | None
    days: int
    time_zone: str
    as_of: datetime
    from_day: str
    through_day: str


def resolve_request(workspace: str | None = None, days: int | None = None, time_zone: str | None = None, as_of: datetime | None = None) -> Request:
    """Checks in this order: workspace's type, the zone's type, the zone, the number of days (1 to 366). None means the
    default: all workspaces, UTC, 30 days, now. The last day is as_of's day in the zone."""
    if workspace is not None and not isinstance(workspace, str):
        raise TypeError("workspace must be a string or None")
    zone = "UTC" if time_zone is None else time_zone
    if not isinstance(zone, str) or not zone:
        raise TypeError("time_zone must be a non-empty string")
    try:
        info = ZoneInfo(zone)
    except Exception as e:
        raise ValueError(f"unknown time zone: {zone}") from e
    days = DEFAULT_DAYS if days is None else days
    if isinstance(days, bool) or not isinstance(days, int) or not 1 <= days <= MOST_DAYS:
        raise ValueError(f"days must be an integer from 1 to {MOST_DAYS}")
    as_of = as_of or datetime.now(UTC)
    through = as_of.astimezone(info).date()
    return Request(workspace, days, zone, as_of, (through - timedelta(days - 1)).isoformat(), through.isoformat())
