"""Runtime parameters.

Every date that the models depend on is a field of :class:`Settings`, so a
change of parameter never means a change of query text.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from datetime import date


class MissingSetting(ValueError):
    """A parameter without a default was not provided."""


@dataclass(frozen=True)
class Settings:
    """Parameters of the warehouse models.

    ``exclude_confirmed_from`` is the switch of the revenue model: from that day
    on, confirmed orders are left out. ``None`` turns the exclusion off.
    """

    # The accepted order states and the default parameter dates.
    accepted_statuses: tuple[str, ...] = ("completed", "confirmed", "shipped")
    excluded_status: str = "confirmed"
    exclude_confirmed_from: date | None = date(2026, 8, 20)
    recent_start: date = date(2026, 8, 15)

    @classmethod
    def from_environment(cls, prefix: str = "SHELFWATCH_") -> Settings:
        """Override the date parameters from environment variables."""
        changes = {}
        for field in fields(cls):
            raw = os.environ.get(prefix + field.name.upper())
            if raw is not None and field.name in ("exclude_confirmed_from", "recent_start"):
                changes[field.name] = date.fromisoformat(raw) if raw else None
        return cls(**changes)


def required_env(name: str, default: str | None = None) -> str:
    """Value of an environment variable; no value and no default is an error."""
    value = os.environ.get(name, default)
    if value is None:
        raise MissingSetting(f"Env var required but not provided: '{name}'")
    return value
