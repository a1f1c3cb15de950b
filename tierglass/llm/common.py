"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierglass.session import cut_lineage


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder of ``spark.checkpoint.dir``, so that lost executors cost nothing."""
    return cut_lineage(df)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string")) % n


def is_remainder(key: Column, n: int, r: int) -> Column:
    """Whether the key has this remainder; a null key has none."""
    return F.coalesce(remainder(key, n) == r, F.lit(False))


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with the columns of a DDL string added."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
