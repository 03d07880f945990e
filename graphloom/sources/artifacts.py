"""A program graph on disk: a folder of Parquet tables with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def write(tables: dict[str, DataFrame], path: str, repo_id: str = "repo") -> None:
    """Each table under its name, by repo_id, then the manifest: rows and a hash of the content of each."""
    entries = {}
    for name, df in tables.items():
        df.withColumn("repo_id", F.lit(repo_id)).write.mode("overwrite").partitionBy("repo_id").parquet(f"{path}/{name}")
        entries[name] = summary(df)
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps({"version": VERSION, "repo_id": repo_id, "tables": entries}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def summary(df: DataFrame) -> dict:
    """Rows, and the exclusive or of the rows' hashes, whatever their order."""
    plain = df.select(*[F.to_json(F.struct(c)).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    r = plain.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*plain.columns)), F.lit(0)).alias("h")).first()
    return {"rows": r["n"], "hash": r["h"]}


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def read(spark: SparkSession, path: str, name: str, verify: bool = False) -> DataFrame:
    """A table; with verify its rows and hash must be those of the manifest."""
    df = spark.read.parquet(f"{path}/{name}").drop("repo_id")
    if verify and summary(df) != manifest(spark, path)["tables"][name]:
        raise ValueError(f"{name} isn't what was written")
    return df


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows) of a written graph."""
    return spark.createDataFrame([(k, v["rows"]) for k, v in sorted(manifest(spark, path)["tables"].items())], "name string, rows long")


def write_diagrams(diagrams: dict[str, DataFrame], path: str) -> None:
    """Each diagram's lines, in order, as one text file under its name."""
    for name, lines in diagrams.items():
        lines.orderBy("ord").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
