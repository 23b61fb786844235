"""Loads every query module, so that the registry is complete."""

from __future__ import annotations

from . import event_queries, match_queries, page_queries, section_queries, text_queries
from .registry import PLANS

MODULES = (page_queries, text_queries, match_queries, section_queries, event_queries)


def names() -> list[str]:
    return list(PLANS)
