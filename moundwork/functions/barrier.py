"""Compute-once columns.

A filter above a projection is rewritten in terms of the projection's inputs, so an expensive
expression used in several derived columns is copied into every one of them. A one-element
``inline`` stops the rewriting: the columns are computed once per row and then only referenced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(packed))
