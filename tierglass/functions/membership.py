"""Membership of keys in a set too large to broadcast, before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit cells of the filter. A cell is one row of two numbers, so what is broadcast has at most so many.
CELLS = 1 << 20
_CELL, _BITS = "_cell", "_bits"


def _cell(columns: list[str], cells: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(cells))


def _mask(columns: list[str]) -> Column:
    """Three bits of a cell, from another hash than the one that picks it."""
    h = F.xxhash64(F.lit(7), *columns)
    one = F.lit(1).cast("long")
    bits = [
        F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(3)
    ]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def filter_of(keys: DataFrame, columns: list[str], cells: int = CELLS) -> DataFrame:
    """The keys as a blocked Bloom filter: a row for every cell in use, at most ``cells``."""
    return keys.groupBy(_cell(columns, cells).alias(_CELL)).agg(F.bit_or(_mask(columns)).alias(_BITS))


def probable(rows: DataFrame, members: DataFrame, columns: list[str], cells: int = CELLS) -> DataFrame:
    """Rows whose key may be in the set; every member is, and few others while the filter is not full."""
    found = rows.withColumn(_CELL, _cell(columns, cells)).join(F.broadcast(members), _CELL)
    return found.where(F.col(_BITS).bitwiseAND(_mask(columns)) == _mask(columns)).select(*rows.columns)


def with_probable(
    rows: DataFrame, members: DataFrame, columns: list[str], name: str, cells: int = CELLS
) -> DataFrame:
    """Rows with a column that tells whether their key may be in the set."""
    found = rows.withColumn(_CELL, _cell(columns, cells)).join(F.broadcast(members), _CELL, "left")
    mask = _mask(columns)
    may = F.coalesce(F.col(_BITS).bitwiseAND(mask) == mask, F.lit(False))
    return found.select(*rows.columns, may.alias(name))
