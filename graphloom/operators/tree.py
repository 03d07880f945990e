"""Trees in interval encoding: a node has its preorder number, depth and subtree size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def excess(parens: DataFrame, key: str = "file_id", pos: str = "pos") -> DataFrame:
    """Adds excess, the running number of open less closed parentheses, and rank1, the running number of open ones."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("is_open"), 1).otherwise(-1)
    return parens.withColumn("excess", F.sum(step).over(w)).withColumn("rank1", F.sum(F.col("is_open").cast("int")).over(w))


def select1(parens: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, k, pos): the place of the k-th open parenthesis."""
    return excess(parens, key).filter("is_open").select(key, F.col("rank1").alias("k"), "pos")


def match_parens(parens: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, open_pos, close_pos): the n-th open parenthesis of a level pairs with the n-th close one of it."""
    level = F.when(F.col("is_open"), F.col("excess")).otherwise(F.col("excess") + 1)
    leveled = excess(parens, key).withColumn("level", level)
    nth = F.row_number().over(Window.partitionBy(key, "level", "is_open").orderBy("pos"))
    leveled = leveled.withColumn("nth", nth)
    opens = leveled.filter("is_open").select(key, "level", "nth", F.col("pos").alias("open_pos"))
    closes = leveled.filter("NOT is_open").select(key, "level", "nth", F.col("pos").alias("close_pos"))
    return opens.join(closes, [key, "level", "nth"]).select(key, "open_pos", "close_pos")


def nodes_of(parens: DataFrame, key: str = "file_id", label: str = "name") -> DataFrame:
    """(key, pre, depth, size, label, open_pos, close_pos) from balanced parentheses."""
    pairs = match_parens(parens, key)
    opens = excess(parens, key).filter("is_open").select(key, F.col("pos").alias("open_pos"), (F.col("rank1") - 1).alias("pre"), F.col("excess").alias("depth"), label)
    return opens.join(pairs, [key, "open_pos"]).withColumn("size", ((F.col("close_pos") - F.col("open_pos") + 1) / 2).cast("long"))


def parents(nodes: DataFrame, key: str = "file_id") -> DataFrame:
    """Adds parent by an as-of step: a node of depth d takes the last node of depth d-1 before it. One sort, no pairs."""
    asks = nodes.select(key, (F.col("depth") - 1).alias("level"), "pre", F.lit(1).alias("side"))
    gives = nodes.select(key, F.col("depth").alias("level"), "pre", F.lit(0).alias("side"))
    w = Window.partitionBy(key, "level").orderBy("pre", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = asks.unionByName(gives).withColumn("parent", F.last(F.when(F.col("side") == 0, F.col("pre")), ignorenulls=True).over(w)).filter("side = 1")
    return nodes.join(found.select(key, "pre", "parent"), [key, "pre"])


def siblings(nodes: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, pre, first_child, next_sibling)"""
    w = Window.partitionBy(key, "parent").orderBy("pre")
    following = nodes.withColumn("next_sibling", F.when(F.col("parent").isNotNull(), F.lead("pre").over(w)))
    return following.select(key, "pre", F.when(F.col("size") > 1, F.col("pre") + 1).alias("first_child"), "next_sibling")


def subtree(nodes: DataFrame, of: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, root, pre): the nodes below given roots (key, root), each root with itself."""
    roots = nodes.join(of, [key]).filter(F.col("pre") == F.col("root")).select(key, "root", F.col("size").alias("n"))
    return nodes.join(roots, [key]).filter((F.col("root") <= F.col("pre")) & (F.col("pre") < F.col("root") + F.col("n"))).select(key, "root", "pre")


def lca(nodes: DataFrame, pairs: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, a, b, lca): the deepest node above both of a pair (key, a, b), a node counting as above itself."""
    up = nodes.select(key, F.col("pre").alias("lca"), F.col("size").alias("n"), F.col("depth").alias("d"))
    over = pairs.join(up, [key]).filter((F.col("lca") <= F.least("a", "b")) & (F.greatest("a", "b") < F.col("lca") + F.col("n")))
    return over.groupBy(key, "a", "b").agg(F.max_by("lca", "d").alias("lca"))


def span_rollup(nodes: DataFrame, spans: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, pre, first_tok, last_tok): least and greatest token of a node's subtree; spans are (key, pre, tok)."""
    own = spans.select(key, F.col("pre").alias("_at"), "tok")
    inside = nodes.join(own, [key]).filter((F.col("pre") <= F.col("_at")) & (F.col("_at") < F.col("pre") + F.col("size")))
    return inside.groupBy(key, "pre").agg(F.min("tok").alias("first_tok"), F.max("tok").alias("last_tok"))


def reparent(nodes: DataFrame, kept, key: str = "file_id") -> DataFrame:
    """Nodes for which kept holds, under the nearest kept node above: (key, pre, parent)."""
    keep = nodes.filter(kept)
    up = keep.select(key, F.col("pre").alias("_p"), F.col("size").alias("_s"))
    over = keep.join(up, [key]).filter((F.col("_p") < F.col("pre")) & (F.col("pre") < F.col("_p") + F.col("_s")))
    return keep.select(key, "pre").join(over.groupBy(key, "pre").agg(F.max("_p").alias("parent")), [key, "pre"], "left")


def enclosing(points: DataFrame, ranges: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds value of the innermost range (key, lo, hi, value) that covers `at`; ranges nest. Null if none does. Ranges join by key first, so a range join never spans keys."""
    hit = points.join(ranges.select(key, "lo", "hi", value), [key]).filter((F.col("lo") <= F.col(at)) & (F.col(at) < F.col("hi")))
    best = hit.groupBy(key, at).agg(F.max_by(value, "lo").alias(value))
    return points.join(best, [key, at], "left")


def bp_positions(nodes: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, pre, open_pos, close_pos) from preorder number, depth from 1 and size alone."""
    at = 2 * F.col("pre") + 1 - F.col("depth")
    return nodes.select(key, "pre", at.alias("open_pos"), (at + 2 * F.col("size") - 1).alias("close_pos"))


def bad_trees(nodes: DataFrame, key: str = "file_id") -> DataFrame:
    """Keys whose table isn't a tree: sizes don't add up, or a parent doesn't come before its child."""
    sums = nodes.groupBy(key).agg(F.count("*").alias("n"), F.max(F.when(F.col("pre") == 0, F.col("size"))).alias("root"), F.max(F.col("parent") >= F.col("pre")).alias("bad"))
    return sums.filter("n <> root OR bad").select(key)
