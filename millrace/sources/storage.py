"""Folders, as the session's file systems see them."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _open(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full name with scheme, as Spark writes it in file paths."""
    path, files = _open(spark, folder)
    return files.makeQualified(path).toString().rstrip("/")


def children(spark: SparkSession, folder: str) -> list[str]:
    path, files = _open(spark, folder)
    return [s.getPath().toString() for s in files.listStatus(path)] if files.exists(path) else []


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder and all below it; a missing one is fine."""
    path, files = _open(spark, folder)
    if files.exists(path):
        files.delete(path, True)


def matches_any(spark: SparkSession, pattern: str) -> bool:
    path, files = _open(spark, pattern)
    found = files.globStatus(path)
    return found is not None and len(found) > 0


def literal(text: str) -> str:
    """The text with characters escaped that mean something in a path pattern."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", text)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark itself broadcasts a side of a join; negative if it never does."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
