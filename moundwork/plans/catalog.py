"""Imports every section so that its queries register."""

from __future__ import annotations

import importlib

from moundwork.plans.registry import CATALOG

SECTIONS = (
    "check_tables", "appearance_queries", "rolling_queries", "label_queries",
    "aggregate_queries", "text_queries", "source_queries", "quality_queries",
    "scoring_queries", "evaluation_queries", "stream_queries", "training_queries",
)


def load() -> dict:
    for section in SECTIONS:
        importlib.import_module(f"moundwork.plans.{section}")
    return CATALOG
