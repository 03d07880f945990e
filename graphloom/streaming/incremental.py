"""File changes as a stream: what changed, what must be rebuilt, and the upsert of a file's rows.

A change is (repo_id, file_id, hash, change, text); a repeated hash is no change. Batches are
idempotent: a file's rows replace those of its earlier content, and a batch that
comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalar as S


def latest(changes: DataFrame, order: str = "ts") -> DataFrame:
    """The last change of each file."""
    w = Window.partitionBy("repo_id", "file_id").orderBy(F.desc(order), F.desc("hash"))
    return changes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def to_rebuild(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Adds scope (None, Behavioral, Structural, Full) to changes whose hash differs from the known one (repo_id, file_id, hash)."""
    old = known.select("repo_id", "file_id", F.col("hash").alias("_old"))
    new = changes.join(old, ["repo_id", "file_id"], "left").filter(~F.col("hash").eqNullSafe(F.col("_old")))
    return new.withColumn("scope", F.when(F.col("_old").isNull(), "Full").otherwise(S.rebuild_scope(F.col("change")))).drop("_old")


def upsert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with all rows of the files in `rows` replaced by those."""
    touched = rows.select("repo_id", "file_id").distinct()
    return table.join(touched, ["repo_id", "file_id"], "left_anti").unionByName(rows)


def start(changes: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A streaming query that keeps the table `build` makes of changed files under path, one folder for each repository and file."""

    def batch(df: DataFrame, number: int) -> None:
        rows = build(latest(df))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "file_id").parquet(path)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; the same over a stream, with a watermark, and over a table. An extra beside the program graph."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,6)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
