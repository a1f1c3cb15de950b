"""Files of small bookkeeping, on whatever store the session's paths name."""

from __future__ import annotations

import threading

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Stores make create-if-absent atomic between drivers; within one, a local disk needs this.
_creating = threading.Lock()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, name: str) -> bool:
    path, store = _path(spark, name)
    return store.exists(path)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, in order; none where there is no folder."""
    path, store = _path(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []


def delete(spark: SparkSession, name: str) -> None:
    """Remove a file or a folder of this library's own making."""
    path, store = _path(spark, name)
    store.delete(path, True)


def create(spark: SparkSession, name: str, text: str) -> bool:
    """Write a new file; false if there is one of that name already."""
    path, store = _path(spark, name)
    with _creating:
        try:
            out = store.create(path, False)
        except Py4JJavaError as problem:
            if "FileAlreadyExistsException" in str(problem.java_exception) or store.exists(path):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
    return True


def read(spark: SparkSession, name: str) -> str:
    path, store = _path(spark, name)
    stream = store.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
