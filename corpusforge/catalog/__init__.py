"""Registered queries over the driver tables with their comparison SQL."""

from __future__ import annotations

from . import corpus, evaluation, loop, outcomes, samples, similar, stored, texts, words  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
