"""Registry of the named queries and of the SQL that states each of them."""

from __future__ import annotations

from tessera.plans import entities, events, frames, media, states
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = entities.memory_assist_decisions
_ = events, frames, media, states
