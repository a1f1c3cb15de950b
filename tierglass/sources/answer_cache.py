"""The answer cache as a stored table: read by prefix, upserted in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierglass.functions.membership import filter_of, probable
from tierglass.operators.answers import CACHE_KEY, cache_upsert
from tierglass.sources import files

ENTRIES = (
    "model string, prompt_hash string, label string, score double, reasoning string, raw_response string, "
    "updated_at timestamp"
)
#: Hex digits of ``prompt_hash`` that name the folder of an entry: 256 folders.
DIGITS = 2


def _prefix(digits: int):
    return F.substring("prompt_hash", 1, digits)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    if not files.exists(spark, f"{path}/entries"):
        return spark.createDataFrame([], f"{ENTRIES}, prefix string")
    return spark.read.schema(f"{ENTRIES}, prefix string").parquet(f"{path}/entries")


def _prefixes(rows: DataFrame, digits: int) -> list[str]:
    """The folders that rows belong to, at most 16^digits."""
    return [r[0] for r in rows.select(_prefix(digits)).distinct().collect()]


def _overwrite(rows: DataFrame, folder: str) -> None:
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("prefix")
        .parquet(folder)
    )


def finish_upserts(spark: SparkSession, path: str) -> None:
    """Complete upserts that were stopped while folders were being replaced; drop those that hadn't come so far.

    What is pending holds all entries of the folders it touches, so it may be applied any number of times.
    """
    for name in files.names(spark, f"{path}/pending"):
        pending = f"{path}/pending/{name}"
        if files.exists(spark, f"{pending}/_SUCCESS"):
            _overwrite(spark.read.schema(f"{ENTRIES}, prefix string").parquet(pending), f"{path}/entries")
        files.delete(spark, pending)


def store_answers(new: DataFrame, path: str, cache_fallbacks: bool = True, digits: int = DIGITS) -> list[str]:
    """Upsert answers into the stored cache; returns the prefixes of the folders that were rewritten.

    Entries lie in folders by the first ``digits`` characters of their ``prompt_hash``, the same for
    the life of a cache. Only folders that get an entry are read, merged and replaced; the others are
    not touched. The merged rows are complete in a pending folder before any entry is replaced, so an
    upsert that is stopped anywhere is either not there or finished by the next call. Running it again
    gives the same table: the last write of a key wins, equal times are decided by the values. One
    upsert runs at a time.

    A folder holds an even share of the hashes, so no key makes one large; a prompt asked by very many
    copies is one entry.
    """
    spark = new.sparkSession
    new = new.where("prompt_hash is not null")
    finish_upserts(spark, path)
    touched = _prefixes(new, digits)
    if not touched:
        return []
    stored = _entries(spark, path).where(F.col("prefix").isin(touched)).drop("prefix")
    merged = cache_upsert(stored, new, cache_fallbacks).withColumn("prefix", _prefix(digits))
    pending = f"{path}/pending/{uuid.uuid4().hex}"
    # The rows of a folder meet first, so that it gets few files and not one from every task; Spark splits
    # a folder that is large. A plain write, as it marks success in its folder.
    merged.hint("rebalance", "prefix").write.partitionBy("prefix").parquet(pending)
    finish_upserts(spark, path)
    return sorted(touched)


def stored_answers(
    spark: SparkSession, path: str, requests: DataFrame | None = None, digits: int = DIGITS
) -> DataFrame:
    """Entries of a stored cache; with ``requests``, few more than those that they ask for.

    Requests should be stored or cheap, as they are read twice: for the prefixes, which prune folders,
    and for a Bloom filter of their keys of at most 2^20 cells, which drops entries that nobody asks
    for where they are scanned. So a join of the result with the requests moves the entries asked for,
    not the cache.
    """
    finish_upserts(spark, path)
    entries = _entries(spark, path)
    if requests is None:
        return entries.drop("prefix")
    asked = requests.select(*CACHE_KEY)
    pruned = entries.where(F.col("prefix").isin(_prefixes(asked, digits))).drop("prefix")
    return probable(pruned, filter_of(asked, list(CACHE_KEY)), list(CACHE_KEY))
