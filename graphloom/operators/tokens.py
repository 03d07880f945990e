"""Lexing, token ids, dictionary encoding and sweeps over token streams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.closure import cut

#: Words, numbers, runs of blanks, and any other single character.
PATTERN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[ \t\r\x0b\x0c]+|."
#: Words that open a declaration, and words that can't be its name.
DECLARES = ("class", "interface", "enum", "struct", "trait", "record", "object")
BLOCKED = ("public", "private", "protected", "static", "final", "abstract", "class", "interface", "enum", "struct", "trait", "record", "object", "extends", "implements")


_WORD = r"^[A-Za-z_][A-Za-z0-9_]*$"
_BLANK_CODES = np.array([32, 9, 13, 11, 12], np.uint32)


def lex_text(find, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a text with their lines, columns and lengths. find gives every piece of the text in order, newlines by themselves, so that places follow from lengths."""
    pieces = find(text)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[starts]
    newline = codes == 10
    line = np.cumsum(newline) + 1
    col = starts - np.maximum.accumulate(np.where(newline, ends, 0)) if len(pieces) else starts
    kept = ~newline & ~np.isin(codes, _BLANK_CODES)
    return list(compress(pieces, kept)), line[kept], col[kept], sizes[kept]


def lex(files: DataFrame, id_col: str = "file_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(file_id, line from 1, col from 0, ord from 0 in the file, text, len) without blanks: one pass, no shuffle. A null text has no tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern + r"|\n").findall
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces, line, col, size = lex_text(find, text or "")
                for at in range(0, len(pieces), 100_000):
                    part = slice(at, at + 100_000)
                    n = len(pieces[part])
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(line[part], pa.int32()), pa.array(col[part], pa.int32()), pa.array(np.arange(at, at + n)), pa.array(pieces[part], pa.string()), pa.array(size[part], pa.int32())], names=["file_id", "line", "col", "ord", "text", "len"])

    return files.select(F.col(id_col).cast("long").alias("file_id"), F.col(text_col).alias("text")).mapInArrow(work, "file_id long, line int, col int, ord long, text string, len int")


def lex_files(files: DataFrame, id_col: str = "file_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(file_id, tokens): a row for each file, its tokens a list of (text, line, col, len). What is asked of whole files need not move single tokens."""
    kind = "file_id long, tokens array<struct<text:string,line:int,col:int,len:int>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern + r"|\n").findall
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces, *rest = lex_text(find, text or "")
                made = pa.StructArray.from_arrays([pa.array(pieces, pa.string()), *(pa.array(x, pa.int32()) for x in rest)], names=["text", "line", "col", "len"])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), made)], names=["file_id", "tokens"])

    return files.select(F.col(id_col).cast("long").alias("file_id"), F.col(text_col).alias("text")).mapInArrow(work, kind)


def tokens_per_file(tokens: DataFrame, order: str = "file_id") -> DataFrame:
    """(file_id, first_token_id, token_count): ids are dense over the files in order."""
    return first_ids(tokens.groupBy("file_id").agg(F.count("*").alias("token_count")), order)


def first_ids(counts: DataFrame, order: str = "file_id") -> DataFrame:
    """(file_id, first_token_id, token_count) from files and their counts. Running sums are made within range partitions; only the partitions' totals meet in one task."""
    placed = cut(counts.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    inside = F.sum("token_count").over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    totals = placed.groupBy("_p").agg(F.sum("token_count").alias("_n"))
    starts = totals.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    rows = placed.withColumn("_i", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "_p")
    return rows.select("file_id", (F.col("_s") + F.col("_i")).alias("first_token_id"), "token_count")


def allocate_ids(tokens: DataFrame) -> DataFrame:
    """Adds token_id: the file's first id plus the place in the file."""
    return tokens.join(tokens_per_file(tokens), "file_id").withColumn("token_id", F.col("first_token_id") + F.col("ord")).drop("first_token_id", "token_count")


def tokens_with_ids(files: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(file_id, ord, token_id, text, line, col, len): texts are lexed once; a file's first id is joined to its row, and only then are tokens rows."""
    rows = cut(lex_files(files, id_col, text_col))
    firsts = first_ids(rows.select("file_id", F.size("tokens").cast("long").alias("token_count")))
    every = rows.join(firsts, "file_id").select("file_id", "first_token_id", F.posexplode("tokens").alias("ord", "t"))
    return every.select("file_id", F.col("ord").cast("long").alias("ord"), (F.col("first_token_id") + F.col("ord")).alias("token_id"), "t.*")


def dup_ordinal(tokens: DataFrame) -> DataFrame:
    """Adds dup: the ordinal of a token among those at its place, from 0, in eight bits."""
    w = Window.partitionBy("file_id", "line", "col").orderBy("ord")
    return tokens.withColumn("dup", (F.row_number().over(w) - 1).bitwiseAND(255).cast("long"))


def intern(tokens: DataFrame) -> DataFrame:
    """(text, text_id, n): ids in the order of first occurrence by file and place. The ranking runs over distinct texts, by range partitions and their sizes."""
    by_file = tokens.groupBy("text", "file_id").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    first = by_file.groupBy("text").agg(F.min(F.struct("file_id", "ord")).alias("at"), F.sum("n").alias("n"))
    return ranked(first.select("text", "n", F.col("at.file_id").alias("_f"), F.col("at.ord").alias("_o")), ["_f", "_o"], "text_id").select("text", "text_id", "n")


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a dense rank from 0 by columns that tell rows apart, without a window over everything: numbers within range partitions, plus the sizes of those before."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = cut(placed).withColumn("_p", F.shiftright("_m", 33))  # read twice, so it must not be dealt out anew
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_m").bitwiseAND((1 << 33) - 1) + F.col("_s")).drop("_m", "_p", "_s")


def filter_trivia(tokens: DataFrame, keep_doc: bool = True, keep_line: bool = False, keep_block: bool = False, keep_blank: bool = False) -> DataFrame:
    dropped = [t for t, keep in (("CommentDoc", keep_doc), ("CommentLine", keep_line), ("CommentBlock", keep_block), ("Whitespace", keep_blank), ("Newline", keep_blank)) if not keep]
    return tokens.filter(~F.col("token_type").isin(dropped))


def name_after(tokens: DataFrame, openers: tuple[str, ...] = DECLARES, reach: int = 15, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """(file_id, ord, keyword, name): for each opening word the first identifier behind it, within reach, that isn't blocked."""
    w = Window.partitionBy("file_id").orderBy("ord").rowsBetween(1, reach)
    fits = F.when(F.col("text").rlike(_WORD) & ~F.col("text").isin(*blocked), F.col("text"))
    named = tokens.withColumn("name", F.first(fits, ignorenulls=True).over(w))
    return named.filter(F.col("text").isin(*openers) & F.col("name").isNotNull()).select("file_id", "ord", F.col("text").alias("keyword"), "name")


def name_before(tokens: DataFrame, stops: tuple[str, ...]) -> DataFrame:
    """(file_id, line, name): the last identifier of a line before its first stop."""
    stop = tokens.filter(F.col("text").isin(*stops)).groupBy("file_id", "line").agg(F.min("ord").alias("stop"))
    word = tokens.filter(F.col("text").rlike(_WORD))
    found = word.join(stop, ["file_id", "line"]).filter(F.col("ord") < F.col("stop"))
    return found.groupBy("file_id", "line").agg(F.max_by("text", "ord").alias("name"))


def declarations(tokens: DataFrame, reach: int = 10) -> DataFrame:
    """(file_id, name, keyword): capitalised names behind opening words, one for each file and name, the first."""
    found = name_after(tokens, reach=reach).filter(F.col("name").rlike("^[A-Z]"))
    return found.groupBy("file_id", "name").agg(F.min_by("keyword", "ord").alias("keyword"))


def packages(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(file_id, package): the first package statement of each file."""
    return files.select("file_id", F.regexp_extract(text_col, r"(?m)^\s*package\s+([A-Za-z_][A-Za-z0-9_.]*)", 1).alias("package")).filter("package <> ''")


def package_prefixes(found: DataFrame) -> DataFrame:
    """(qual_name, name, parent): a row for every prefix of every package."""
    parts = F.split("package", r"\.")
    every = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("qual_name")).distinct()
    return every.select("qual_name", F.regexp_extract("qual_name", r"([^.]*)$", 1).alias("name"), F.nullif(F.regexp_extract("qual_name", r"^(.*)\.[^.]*$", 1), F.lit("")).alias("parent"))


def imports(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(file_id, qual_name, package): imported names and the packages they are in."""
    names = F.explode(F.regexp_extract_all(text_col, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z_][A-Za-z0-9_.]*)"), 1)).alias("qual_name")
    return files.select("file_id", names).withColumn("package", F.regexp_extract("qual_name", r"^(.*)\.[^.]*$", 1)).filter("package <> ''")


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str) -> DataFrame:
    """Adds value from the right row nearest at or before `on` within keys (null if none), and the first behind it as value_next. One sort of both sides together; no pairs."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(right.select(*keys, on, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    back = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(1, Window.unboundedFollowing)
    seen = both.withColumn(value, F.last("_v", ignorenulls=True).over(back)).withColumn(f"{value}_next", F.first("_v", ignorenulls=True).over(ahead))
    return seen.filter("_side = 1").drop("_v", "_side")
