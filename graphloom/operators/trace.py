"""Traceability: spans of entities in sources, links, staleness and deltas. A missing span is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINKED_KINDS = ("CLASS", "INTERFACE", "ENUM", "RECORD", "METHOD", "CONSTRUCTOR", "FIELD", "PACKAGE", "ANNOTATION")


def spans(layer: str, rows: DataFrame, entity: str) -> DataFrame:
    """(layer, entity_id, first_tok, last_tok) of a table with token ranges."""
    return rows.select(F.lit(layer).alias("layer"), F.col(entity).alias("entity_id"), "first_tok", "last_tok")


def block_spans(blocks: DataFrame, stmts: DataFrame) -> DataFrame:
    """(fn_sym, block, first_tok, last_tok) over a block's statements (fn_sym, block, first_tok, last_tok); null for an empty block."""
    inner = stmts.groupBy("fn_sym", "block").agg(F.min("first_tok").alias("first_tok"), F.max("last_tok").alias("last_tok"))
    return blocks.select("fn_sym", "block").join(inner, ["fn_sym", "block"], "left")


def ssa_spans(defs: DataFrame, blocks: DataFrame, stmts: DataFrame) -> DataFrame:
    """(fn_sym, ssa_id, first_tok, last_tok): of the defining statement, of a phi its block's."""
    of = stmts.select("fn_sym", F.col("stmt").alias("def_stmt"), F.col("first_tok").alias("f1"), F.col("last_tok").alias("l1"))
    at = block_spans(blocks, stmts).select("fn_sym", F.col("block").alias("def_block"), F.col("first_tok").alias("f2"), F.col("last_tok").alias("l2"))
    rows = defs.join(of, ["fn_sym", "def_stmt"], "left").join(at, ["fn_sym", "def_block"], "left")
    return rows.select("fn_sym", "ssa_id", F.when(F.col("is_phi"), F.col("f2")).otherwise(F.col("f1")).alias("first_tok"), F.when(F.col("is_phi"), F.col("l2")).otherwise(F.col("l1")).alias("last_tok"))


def located(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds file_id, line_start, col_start, line_end, col_end (behind the last token) to rows with first_tok and last_tok."""
    a = tokens.select(F.col("token_id").alias("first_tok"), "file_id", F.col("line").alias("line_start"), F.col("col").alias("col_start"))
    b = tokens.select(F.col("token_id").alias("last_tok"), F.col("line").alias("line_end"), (F.col("col") + F.col("len")).alias("col_end"))
    return rows.join(a, "first_tok", "left").join(b, "last_tok", "left")


def located_in_files(layer: str, rows: DataFrame, files: DataFrame) -> DataFrame:
    """(layer, entity_id, file_id, first_tok, last_tok, line_start, col_start, line_end, col_end): rows (entity_id, file_id, first_tok, last_tok as places in the file) located in their files' lists of tokens (file_id, tokens, first_token_id). A file's rows meet its list once; no token becomes a row."""
    held = rows.groupBy("file_id").agg(F.collect_list(F.struct("entity_id", "first_tok", "last_tok")).alias("held"))
    each = held.join(files, "file_id").select("file_id", "first_token_id", F.explode(F.transform("held", lambda x: F.struct(x.alias("x"), F.get("tokens", x["first_tok"].cast("int")).alias("a"), F.get("tokens", x["last_tok"].cast("int")).alias("b")))).alias("y"))
    tok = lambda c: (F.col("first_token_id") + F.col(f"y.x.{c}")).alias(c)
    return each.select(F.lit(layer).alias("layer"), "y.x.entity_id", "file_id", tok("first_tok"), tok("last_tok"), F.col("y.a.line").alias("line_start"), F.col("y.a.col").alias("col_start"), F.col("y.b.line").alias("line_end"), (F.col("y.b.col") + F.col("y.b.len")).alias("col_end"))


def covering(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file_id, tok, entity_id, depth): entities whose token range covers a point (file_id, tok), the innermost first (depth 1)."""
    from pyspark.sql import Window

    hit = points.join(ranges, "file_id").filter((F.col("first_tok") <= F.col("tok")) & (F.col("tok") <= F.col("last_tok")))
    w = Window.partitionBy("file_id", "tok").orderBy(F.desc("first_tok"), "last_tok", "entity_id")
    return hit.select("file_id", "tok", "entity_id", F.row_number().over(w).cast("long").alias("depth"))


def uml_links(symbols: DataFrame, tokens: DataFrame) -> DataFrame:
    return located(symbols.filter(F.col("kind").isin(*LINKED_KINDS)).select("sym_id", "kind", "first_tok", "last_tok"), tokens)


def to_source(links: DataFrame, syms: DataFrame) -> DataFrame:
    return links.join(syms, "sym_id", "left_semi")


def from_source(links: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, line, sym_id): links that cover given lines (file_id, line)."""
    return lines.join(links.select("file_id", "line_start", "line_end", "sym_id"), "file_id").filter((F.col("line_start") <= F.col("line")) & (F.col("line") <= F.col("line_end"))).select("file_id", "line", "sym_id")


def stale(links: DataFrame, current: DataFrame) -> DataFrame:
    """Links whose file's hash (link_hash) isn't its current one (file_id, hash), or whose file is gone."""
    return links.join(current, "file_id", "left").filter(~F.col("link_hash").eqNullSafe(F.col("hash"))).drop("hash")


def delta(before: DataFrame, after: DataFrame, key: str = "sym_id") -> DataFrame:
    """(key, change): added, removed, or moved where first_tok or last_tok differ."""
    a, b = before.select(key, F.struct("first_tok", "last_tok").alias("x")), after.select(key, F.struct("first_tok", "last_tok").alias("y"))
    both = a.join(b, key, "full")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "moved")
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def bad_spans(rows: DataFrame) -> DataFrame:
    """Entities whose range ends before it starts: should be none."""
    return rows.filter("last_tok < first_tok")


def sorted_spans(rows: DataFrame) -> DataFrame:
    """Adds ord, the place of a span in its file: by first token, the longer of two first."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("first_tok", F.desc("last_tok"), "entity_id")
    return rows.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))


def bad_links(links: DataFrame, symbols: DataFrame, tokens: DataFrame) -> DataFrame:
    """(fault, n): links (sym_id, first_tok, last_tok) to symbols or tokens that don't exist, and symbols linked twice. Every row is looked at. Should be none."""
    known = tokens.select("token_id")
    parts = (
        ("no such symbol", links.join(symbols.select("sym_id"), "sym_id", "left_anti")),
        ("no such token", links.filter("first_tok IS NOT NULL").join(known.withColumnRenamed("token_id", "first_tok"), "first_tok", "left_anti")),
        ("linked twice", links.groupBy("sym_id").agg(F.count("*").alias("n")).filter("n > 1")),
    )
    every = reduce(DataFrame.unionByName, (df.select(F.lit(fault).alias("fault")) for fault, df in parts))
    return every.groupBy("fault").agg(F.count("*").alias("n"))
