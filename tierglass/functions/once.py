"""Expensive columns that the optimizer must not copy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are evaluated here and nowhere else.

    Catalyst pushes filters below a projection by copying the expressions they
    read, for example the non-empty check it adds to every ``explode``; for a
    column made from a text that means scanning the text again. A generator of
    one row is not copied, while filters on other columns still pass below it.
    """
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(values)))
