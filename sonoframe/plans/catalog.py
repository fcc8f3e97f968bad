"""All queries of the library, gathered from the plan modules."""

from __future__ import annotations

from sonoframe.plans import frames, live, sessions, sound, transcripts  # noqa: F401
from sonoframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
