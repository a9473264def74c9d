"""The filled registries: importing the query modules registers their queries."""

from __future__ import annotations

from . import q_analysis, q_design, q_models, q_quality, q_streams, q_transcripts  # noqa: F401
from .registry import ORACLES, QUERIES, register, rounded

__all__ = ["ORACLES", "QUERIES", "register", "rounded"]
