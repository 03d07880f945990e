"""Source trees as file tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators.tokens import ranked


def scan(spark: SparkSession, path: str, rule: str = "server") -> DataFrame:
    """(path, text, sha256, size, mtime) of a tree's sources; rule is cli (three extensions) or server (all known ones, without build, vendor, hidden and test paths). Paths are relative to the tree."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}/", "")
    rows = rows.select(rel.alias("path"), F.col("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    keep = S.is_cli_source(F.col("path")) if rule == "cli" else S.is_server_source(F.col("path"))
    return rows.filter(keep).select("path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("sha256"), "size", "mtime")


def manifest(files: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Adds file_id, dense in path order, and lang."""
    return ranked(files, ["path"], "file_id").withColumn("lang", S.detect_language(F.col("path"), overrides))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: the hash of all files' hashes in path order. The list is one hash for each file."""
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: x["sha256"]), ""), 256).alias("sha256"), F.count("*").alias("n"))
