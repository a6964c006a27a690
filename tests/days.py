"""Dates from text, shared by the fixtures and the tests."""

from __future__ import annotations

import datetime as dt


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)
