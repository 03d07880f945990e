"""Queries over syntax trees (tags of pages) and the geography as a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import tree as T
from graphloom.plans.projections import parens, projected, table, with_ctes
from graphloom.plans.registry import query


def nodes(spark, sf):
    return T.nodes_of(parens(spark, sf))


def tree(spark, sf):
    return T.parents(nodes(spark, sf))


@query("excess_depth", with_ctes("leveled", "SELECT file_id, pos, excess FROM leveled"))
def _(spark, sf):
    return T.excess(parens(spark, sf)).select("file_id", "pos", "excess")


@query("rank1", with_ctes("leveled", "SELECT file_id, pos, rank1 FROM leveled"))
def _(spark, sf):
    return T.excess(parens(spark, sf)).select("file_id", "pos", "rank1")


@query("select1", with_ctes("leveled", "SELECT file_id, rank1 AS k, pos FROM leveled WHERE is_open"))
def _(spark, sf):
    return T.select1(parens(spark, sf)).select("file_id", "k", "pos")


@query("match_paren", with_ctes("nodes", "SELECT file_id, open_pos, close_pos FROM nodes"))
def _(spark, sf):
    return T.match_parens(parens(spark, sf))


@query("ast_nodes", with_ctes("tree", "SELECT file_id, pre, parent, depth, size, name FROM tree"))
def _(spark, sf):
    return tree(spark, sf).select("file_id", "pre", "parent", "depth", "size", "name")


@query("is_leaf", with_ctes("nodes", "SELECT file_id, pre, size = 1 AS is_leaf FROM nodes"))
def _(spark, sf):
    return nodes(spark, sf).select("file_id", "pre", (F.col("size") == 1).alias("is_leaf"))


@query("siblings", with_ctes("tree", "SELECT file_id, pre, CASE WHEN size > 1 THEN pre + 1 END AS first_child, CASE WHEN parent IS NOT NULL THEN lead(pre) OVER (PARTITION BY file_id, parent ORDER BY pre) END AS next_sibling FROM tree"))
def _(spark, sf):
    return T.siblings(tree(spark, sf))


@query("subtree", with_ctes("nodes", "SELECT a.file_id, a.pre AS root, b.pre FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND a.pre <= b.pre AND b.pre < a.pre + a.size WHERE a.name = 'div'"))
def _(spark, sf):
    n = nodes(spark, sf)
    return T.subtree(n, n.filter("name = 'div'").select("file_id", F.col("pre").alias("root")))


@query("lca", with_ctes("nodes", """SELECT p.file_id, p.a, p.b, arg_max(n.pre, n.depth) AS lca FROM (SELECT file_id, pre AS a, pre + 3 AS b FROM nodes) p JOIN nodes m ON m.file_id = p.file_id AND m.pre = p.b
  JOIN nodes n ON n.file_id = p.file_id AND n.pre <= p.a AND p.b < n.pre + n.size GROUP BY p.file_id, p.a, p.b"""))
def _(spark, sf):
    n = nodes(spark, sf)
    there = n.select("file_id", F.col("pre").alias("b"))
    pairs = n.select("file_id", F.col("pre").alias("a"), (F.col("pre") + 3).alias("b")).join(there, ["file_id", "b"], "left_semi")
    return T.lca(n, pairs.select("file_id", "a", "b"))


@query("span_rollup", with_ctes("nodes", "SELECT a.file_id, a.pre, min(b.open_pos) AS first_tok, max(b.open_pos) AS last_tok FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND a.pre <= b.pre AND b.pre < a.pre + a.size GROUP BY a.file_id, a.pre"))
def _(spark, sf):
    n = nodes(spark, sf)
    return T.span_rollup(n, n.select("file_id", "pre", F.col("open_pos").alias("tok")))


@query("reduce_and_encode", with_ctes("nodes", "SELECT a.file_id, a.pre, (SELECT max(b.pre) FROM nodes b WHERE b.file_id = a.file_id AND b.pre < a.pre AND a.pre < b.pre + b.size AND b.name IN ('html', 'body', 'div', 'ul', 'table')) AS parent FROM nodes a WHERE a.name IN ('html', 'body', 'div', 'ul', 'table')"))
def _(spark, sf):
    return T.reparent(nodes(spark, sf), F.col("name").isin("html", "body", "div", "ul", "table"))


@query("enclosing_method", with_ctes("nodes", "SELECT a.file_id, a.pre, (SELECT arg_max(b.pre, b.pre) FROM nodes b WHERE b.file_id = a.file_id AND b.pre <= a.pre AND a.pre < b.pre + b.size AND b.name IN ('div', 'body')) AS method FROM nodes a"))
def _(spark, sf):
    n = nodes(spark, sf)
    ranges = n.filter("name IN ('div', 'body')").select("file_id", F.col("pre").alias("lo"), (F.col("pre") + F.col("size")).alias("hi"), F.col("pre").alias("method"))
    return T.enclosing(n.select("file_id", "pre"), ranges, "file_id", "pre", "method").select("file_id", "pre", "method")


@query("range_enclosing", with_ctes("parens nodes", "SELECT p.file_id, p.pos, (SELECT max(b.open_pos) FROM nodes b WHERE b.file_id = p.file_id AND b.open_pos <= p.pos AND p.pos < b.close_pos) AS callable FROM parens p"))
def _(spark, sf):
    ranges = nodes(spark, sf).select("file_id", F.col("open_pos").alias("lo"), F.col("close_pos").alias("hi"), F.col("open_pos").alias("callable"))
    return T.enclosing(parens(spark, sf).select("file_id", "pos"), ranges, "file_id", "pos", "callable").select("file_id", "pos", "callable")


@query("bp_positions", with_ctes("nodes", "SELECT file_id, pre, open_pos, close_pos FROM nodes"))
def _(spark, sf):
    return T.bp_positions(nodes(spark, sf))


@query("tree_invariants", with_ctes("tree", "SELECT file_id FROM tree GROUP BY file_id HAVING count(*) <> max(CASE WHEN pre = 0 THEN size END) OR bool_or(parent >= pre)"))
def _(spark, sf):
    return T.bad_trees(tree(spark, sf))


@query("hierarchy_lca", """WITH t AS (SELECT n_nationkey AS a, m.n_nationkey AS b, CASE WHEN n.n_nationkey = m.n_nationkey THEN concat('n', n.n_nationkey) WHEN n.n_regionkey = m.n_regionkey THEN concat('r', n.n_regionkey) ELSE 'root' END AS lca FROM nation n, (SELECT n_nationkey, n_regionkey FROM nation) m) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, lca FROM t""".replace("SELECT n_nationkey AS a", "SELECT n.n_nationkey AS a"))
def _(spark, sf):
    """All pairs of the 25 nations, through their interval encoding: the root first, then each region with its nations."""
    from pyspark.sql import Window

    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = r.select(F.col("r_regionkey").alias("g"), F.lit(-1).alias("k"), F.lit(2).alias("depth"), F.concat(F.lit("r"), "r_regionkey").alias("label"))
    rows = rows.unionByName(n.select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("k"), F.lit(3).alias("depth"), F.concat(F.lit("n"), "n_nationkey").alias("label")))
    rows = rows.unionByName(r.limit(1).select(F.lit(-1).alias("g"), F.lit(-1).alias("k"), F.lit(1).alias("depth"), F.lit("root").alias("label")))
    sizes = F.when(F.col("depth") == 1, F.count("*").over(Window.partitionBy("one"))).when(F.col("depth") == 2, F.count("*").over(Window.partitionBy("g"))).otherwise(1)
    t = rows.withColumn("one", F.lit(0)).withColumn("file_id", F.lit(0)).withColumn("pre", F.row_number().over(Window.partitionBy("one").orderBy("g", "k")) - 1).withColumn("size", sizes)
    leaf = t.filter("depth = 3").select("file_id", "pre", "k")
    pairs = leaf.toDF("file_id", "a", "ka").join(leaf.toDF("file_id", "b", "kb"), "file_id")
    names = t.select(F.col("pre").alias("lca"), "label")
    return T.lca(t, pairs.select("file_id", "a", "b")).join(pairs, ["file_id", "a", "b"]).join(names, "lca").select(F.col("ka").cast("long").alias("a"), F.col("kb").cast("long").alias("b"), F.col("label").alias("lca"))
