"""Document sources: text files, inline text, uploads and raw bytes."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierglass.functions.text import strip
from tierglass.sources import trees

# A suffix in front of a compression suffix decides, as in standard file typing.
_SUFFIX = r"(?i)[^/]\.([^./]+?)(?:\.(?:gz|bz2|xz|br|z))?$"
_LAST_SUFFIX = r"[^/](\.[^./]+)$"


def suffixes(kind: str) -> list[str]:
    """File suffixes, without dot, of a main type in the standard type table."""
    types = mimetypes.MimeTypes()
    table = types.types_map[True]
    # Some suffixes stand for two, such as that of a compressed drawing.
    both = {s: table.get(long.rsplit(".", 1)[0].lower()) for s, long in types.suffix_map.items()}
    found = {**{s: t for s, t in both.items() if t}, **table}
    return sorted(s.lstrip(".") for s, t in found.items() if t.startswith(kind + "/"))


def mime_class(path: Column) -> Column:
    """``text``, ``pdf``, ``image`` or null for any other file name."""
    suffix = F.lower(F.regexp_extract(path, _SUFFIX, 1))
    return (
        F.when(suffix.isin(*suffixes("text")), "text")
        .when(suffix == "pdf", "pdf")
        .when(suffix.isin(*suffixes("image")), "image")
    )


def route(docs: DataFrame, path: str = "source", text: str = "text") -> DataFrame:
    """Add ``mime_class``; text of unsupported types becomes empty, rows are kept."""
    return docs.withColumn("mime_class", mime_class(F.col(path))).withColumn(
        text,
        F.when(F.col("mime_class").isNull(), F.lit("")).otherwise(F.coalesce(text, F.lit(""))),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``: source and whole text.

    Only text files are opened; other files are listed and keep an empty text. A folder on the executors'
    local or mounted disks is listed and read by tasks, however many files it has. Other stores, single files
    and patterns are listed by Spark's readers, whose lists are in the driver.
    """
    if trees.is_folder(path):
        found = trees.tree(spark, path)
        is_text = mime_class(F.col("path")).eqNullSafe(F.lit("text"))
        texts = trees.contents(found.where(is_text)).select(F.col("uri").alias("source"), F.col("value").alias("text"))
        others = found.where(~is_text).select(F.concat(F.lit("file:"), "path").alias("source"), F.lit("").alias("text"))
        return texts.unionByName(others)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select(F.col("path").alias("source"))
    others = listed.filter(~mime_class(F.col("source")).eqNullSafe(F.lit("text")))
    texts = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
        .filter(mime_class(F.col("source")) == "text")
    )
    return texts.unionByName(others.withColumn("text", F.lit("")))


def stored_name(identifier: Column, name: Column, default_name: Column, suffix: str) -> Column:
    """Struct of the file name shown and the path stored for new text or an upload."""
    filename = F.coalesce(F.nullif(name, F.lit("")), default_name)
    found = F.nullif(F.regexp_extract(filename, _LAST_SUFFIX, 1), F.lit(""))
    return F.struct(
        filename.alias("filename"),
        F.concat(identifier, F.coalesce(found, F.lit(suffix))).alias("path"),
    )


def inline_documents(df: DataFrame, key: str = "doc_id", name: str = "name") -> DataFrame:
    """Pasted text as documents; existing ``source`` and ``filename`` values stay."""
    identifier = F.col(key).cast("string")
    default = F.concat(F.lit("inline-"), identifier, F.lit(".txt"))
    return _with_defaults(df, stored_name(identifier, F.col(name), default, ".txt"))


def uploaded_documents(df: DataFrame, key: str = "doc_id", name: str = "name") -> DataFrame:
    """Uploaded files as documents; existing ``source`` and ``filename`` values stay."""
    identifier = F.col(key).cast("string")
    return _with_defaults(df, stored_name(identifier, F.col(name), F.lit("document"), ".bin"))


def _with_defaults(df: DataFrame, stored: Column) -> DataFrame:
    given = {c: F.col(c) if c in df.columns else F.lit(None) for c in ("source", "filename")}
    return (
        df.withColumn("_stored", stored)
        .withColumns(
            {
                "source": F.coalesce(given["source"], F.col("_stored.path")),
                "filename": F.coalesce(given["filename"], F.col("_stored.filename")),
            }
        )
        .drop("_stored")
    )


def text_or_fallback(content: Column, pasted: Column) -> Column:
    """Bytes decoded as UTF-8, or the stripped pasted text where that fails."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), strip(pasted))
