"""Queries over the driver's tables, one or more for each operator, with oracle SQL where there can be any."""

from __future__ import annotations

from . import codec, coding, color, formats, geometry, measures, streams, wavelets  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
