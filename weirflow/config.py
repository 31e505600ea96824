"""Settings of the engine; every choice between rival behaviours is a field here."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

#: The funnel's steps in order, and spellings of a paying user.
STEPS = ("app_open", "offer_view", "offer_start", "goal_reached", "reward_paid")
PAYER_TOKENS = ("true", "1", "t", "yes")
PLATFORMS = ("android", "ios")


@dataclass(frozen=True)
class Config:
    """Names of tables and knobs of the flow."""

    catalog: str = ""  #: in front of all names of tables where it is set
    bronze: str = "bronze"
    silver: str = "silver"
    gold: str = "gold"
    steps: tuple[str, ...] = STEPS
    platform_mode: str = "derived"  #: or "column"
    rule_set: str = "v1"  #: or "v2", whose gate also asks for an install of every event
    late_cutoff: timedelta = timedelta(minutes=15)  #: after midnight of the next day
    lookback_days: int = 6
    as_of: date | None = None  #: today where None
    broadcast_bytes: int = 32 * 1024 * 1024
    advisory_bytes: int = 64 * 1024 * 1024

    def table(self, layer: str, name: str) -> str:
        """The name of a table of a layer (bronze, silver, gold)."""
        return ".".join(x for x in (self.catalog, getattr(self, layer), name) if x)
