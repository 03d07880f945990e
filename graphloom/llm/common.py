"""What the training-data operators share: reading, written cuts, Arrow helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all run in one process (tests), a temporary one of our own; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.graphloom.sharedDir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.graphloom.sharedDir", found)
    return found


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here and any executor can reread it. The job's shuffle files go when it has ended, the table by dropped() or with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{what}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        files, at = _file_system(df.sparkSession, df.written_at)
        files.delete(at, True)


@contextlib.contextmanager
def short_plans(spark: SparkSession, most: int = 20_000, fields: int = 4):
    """Plans that hold tables as literals are described in so many characters and by so many columns of a node at most, so that the driver makes and keeps no text of them: every new plan of an adaptive query names each node's columns whole. A literal belongs behind the first columns."""
    with setting(spark, "spark.sql.maxPlanStringLength", str(most)), setting(spark, "spark.sql.debug.maxToStringFields", str(fields)):
        yield


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what an operator reads, under fixed names; a null text counts as empty. Other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def spark_type(kind: str) -> T.StructType:
    return T._parse_datatype_string(kind)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow where f turns a batch into dictionaries of columns."""
    kind = pa.schema([(x.name, _arrow(x.dataType)) for x in spark_type(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in f(batch):
                yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], x.type) if not isinstance(cols[x.name], (pa.Array, pa.ChunkedArray)) else cols[x.name].cast(x.type) for x in kind], schema=kind)

    return df.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    simple = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32(), "smallint": pa.int16()}
    return pa.list_(_arrow(t.elementType)) if isinstance(t, T.ArrayType) else simple[t.simpleString()]


def slices(batch: pa.RecordBatch, text: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `size` bytes of text (one row at least), so that working memory follows that size, not the batch."""
    lengths = [0 if n is None else n for n in pa.compute.binary_length(batch.column(text)).to_pylist()]
    at = used = 0
    for i, n in enumerate(lengths):
        if used and used + n > size:
            yield batch.slice(at, i - at)
            at, used = i, 0
        used += n
    if at < len(lengths):
        yield batch.slice(at)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by integer keys: tables of whole groups, of about `rows` rows or one group, each with the group number of its rows."""

    def changes(t: pa.Table) -> np.ndarray:
        k = np.stack([t.column(c).to_numpy() for c in keys])
        return (k[:, 1:] != k[:, :-1]).any(axis=0)

    def numbered(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        return t, np.concatenate([[0], np.cumsum(changes(t))])

    kept: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            kept.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in kept) >= rows:
            t = pa.concat_tables(kept).combine_chunks()
            at = np.flatnonzero(changes(t))
            cut = int(at[-1]) + 1 if len(at) else 0
            if cut:
                yield numbered(t.slice(0, cut))
            kept = [t.slice(cut)]
    if kept:
        yield numbered(pa.concat_tables(kept).combine_chunks())


def bounded(spark: SparkSession, blob: bytes, most: int):
    """A broadcast of a blob whose size is checked."""
    if len(blob) > most:
        raise ValueError(f"{len(blob)} bytes are too many to broadcast; the bound is {most}")
    return spark.sparkContext.broadcast(blob)


def crc_mod(col, n: int):
    """crc32 of a number as text, mod n; null where the number is null."""
    return F.crc32(col.cast("string").cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, did (a null id counts as before all others), x, y (128 bits of the text) and text. A row is known by did, x and y; rows that agree in all three are one document wherever rows are matched."""
    kept = keyed(docs, id_col, text_col)
    return kept.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"), "text")
