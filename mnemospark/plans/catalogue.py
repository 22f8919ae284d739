"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import event_queries, python_queries, retrieval_queries, session_queries, text_queries, upkeep_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
