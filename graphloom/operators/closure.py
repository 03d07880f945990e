"""Fixpoints over edge tables, a frontier at a time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset and all run in one process (tests), a temporary one; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.graphloom.cutDir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.graphloom.cutDir", found)
    return found


#: Bytes of a written table that may still be broadcast. Files are compressed and joins read few of their columns, so that Spark takes a table for a small part of the room that it needs in the driver.
SMALL = 1 << 20


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again, so that plans don't grow with the rounds, nothing is computed twice and a lost executor's part can be read again. The files go with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    made = spark.read.schema(df.schema).parquet(path)
    return made.hint("merge") if files.getContentSummary(at).getLength() > SMALL else made


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(root, node, dist): all nodes reachable along edges (src, dst) from seeds (root, node), with their least distance. Each round joins the frontier only; what was seen is anti-joined away. With targets (root, node) a root goes no further once all of its own are met."""
    edges = edges.select("src", "dst").distinct()
    seen = frontier = cut(seeds.select("root", "node").distinct().withColumn("dist", F.lit(0).cast("long")))
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        if targets is not None:
            targets = cut(targets.select("root", "node").join(frontier.select("root", "node"), ["root", "node"], "left_anti"))
            frontier = frontier.join(targets.select("root").distinct(), "root", "left_semi")
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("dist", F.lit(depth).cast("long")))
        seen = cut(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


#: Edges that one task hangs to least nodes at a time, before rounds over all tasks.
HUNG = 1 << 19


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges u, v with the least node joined to it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (live := root[a] != root[b]).any():
        a, b = a[live], b[live]
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]


def _hung(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    kept, n = [], 0
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            kept.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            n += batch.num_rows
        if kept and (batch is None or n >= most):
            found = _stars(*(np.concatenate(c) for c in zip(*kept, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "root"])
            kept, n = [], 0


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node joined to a node by edges (src, dst) in any direction. Edges often join neighbours in the order of nodes; so they are hung to least nodes task by task in that order, and only roots that share a node go on, in large-star and small-star steps."""
    links = edges.filter("src <> dst").select(F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v"))
    hung = cut(links.repartitionByRange("u").sortWithinPartitions("u").mapInArrow(partial(_hung, most=HUNG), "node long, root long"))
    torn = cut(hung.groupBy("node").agg(F.min("root").alias("m"), F.count("*").alias("n")).filter("n > 1").select("node", "m"))
    if torn.isEmpty():
        return hung
    joined = cut(_starred(hung.join(torn, "node").filter("root <> m").select(F.col("root").alias("u"), F.col("m").alias("v"))))
    own = hung.join(torn, "node", "left_anti").unionByName(torn.select("node", F.col("m").alias("root")))
    return own.join(joined.toDF("root", "r"), "root", "left").select("node", F.coalesce("r", "root").alias("root"))


def _starred(links: DataFrame) -> DataFrame:
    """(node, root) by links (u, v), u the greater: large-star and small-star steps in turn, two grouped minima and a join each, until nothing moves."""
    links = cut(links.distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = cut(small.filter("u <> v").distinct())
        if (now := state(links)) == before:
            break
        before = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def strong_components(edges: list[tuple[int, int]]) -> dict[int, int]:
    """node -> least node of its strongly connected component, by depth-first search with a stack of open nodes."""
    succ: dict[int, list[int]] = {}
    for a, b in edges:
        succ.setdefault(a, []).append(b)
        succ.setdefault(b, [])
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    out: dict[int, int] = {}
    open_: list[int] = []
    for start in succ:
        if start in index:
            continue
        work = [(start, iter(succ[start]))]
        index[start] = low[start] = len(index)
        open_.append(start)
        while work:
            node, rest = work[-1]
            for b in rest:
                if b not in index:
                    index[b] = low[b] = len(index)
                    open_.append(b)
                    work.append((b, iter(succ[b])))
                    break
                if b not in out:
                    low[node] = min(low[node], index[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    at = open_.index(node) if len(open_) < 64 else len(open_) - 1 - open_[::-1].index(node)
                    members, open_[at:] = open_[at:], []
                    out |= dict.fromkeys(members, min(members))
    return out


#: Edges of a weak component that one task may take whole; larger ones are coloured.
GATHERED = 50_000


def scc(nodes: DataFrame, edges: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """(node, scc_id, scc_size, scc_class): scc_id is the least node of the component; class 0 single, 1 a single node that calls itself, 2 several.

    Weak components of a bounded number of edges are one row each and searched depth first, all in parallel. What is in larger ones is coloured.
    """
    live = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    weak = weak_components(live)
    rooted = cut(live.join(weak, F.col("src") == F.col("node")).select("root", "src", "dst"))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"))
    few = rooted.join(sizes.filter(F.col("n") <= gathered), "root").groupBy("root").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for es in batch.column("edges").to_pylist() for x in strong_components([(e["src"], e["dst"]) for e in es]).items()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["node", "scc_id"])

    found = few.select("edges").mapInArrow(search, "node long, scc_id long")
    many = rooted.join(sizes.filter(F.col("n") > gathered).select("root"), "root", "left_semi").select("src", "dst")
    found = found.unionByName(_coloured(cut(many)))
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    named = nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("scc_id", "node").alias("scc_id"))
    counts = named.groupBy("scc_id").agg(F.count("*").alias("scc_size"))
    sized = named.join(counts, "scc_id").join(loops, "node", "left")
    return sized.select("node", "scc_id", "scc_size", F.when(F.col("scc_size") > 1, 2).when(F.col("loop"), 1).otherwise(0).cast("long").alias("scc_class"))


def scc_levels(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc_id, level): components in an order in which callees come first; level 0 calls no other, every other is one above the highest it calls. Levels rise round by round; only what moved is looked at again."""
    ids = components.select("node", "scc_id")
    a, b = ids.toDF("src", "x"), ids.toDF("dst", "y")
    up = cut(edges.join(a, "src").join(b, "dst").filter("x <> y").select("x", "y").distinct())
    levels = cut(ids.select("scc_id").distinct().withColumn("level", F.lit(0).cast("long")))
    moved = levels
    while not moved.isEmpty():
        raised = up.join(moved, up["y"] == moved["scc_id"]).groupBy("x").agg((F.max("level") + 1).alias("new"))
        moved = cut(levels.join(raised, F.col("scc_id") == F.col("x")).filter("new > level").select("scc_id", F.col("new").alias("level")))
        levels = cut(levels.join(moved.toDF("_s", "_l"), F.col("scc_id") == F.col("_s"), "left").select("scc_id", F.coalesce("_l", "level").alias("level")))
    return levels


def _coloured(live: DataFrame) -> DataFrame:
    """(node, scc_id). Every node takes the greatest node that reaches it as its colour; those that reach their colour's root back, within the colour, are the root's component and leave; and so on with what is left."""
    found = live.select(F.col("src").alias("node"), F.col("src").alias("scc_id")).limit(0)
    while not live.isEmpty():
        # two rounds of trimming; what they leave of long tails colours settle as well
        for _ in range(2):
            inner = live.select(F.col("src").alias("node")).distinct().intersect(live.select(F.col("dst").alias("node")).distinct())
            live = live.join(inner, F.col("src") == F.col("node"), "left_semi").join(inner, F.col("dst") == F.col("node"), "left_semi")
        live = cut(live)
        if live.isEmpty():
            break
        colour = cut(live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct().withColumn("c", F.col("node")))
        while True:
            pushed = live.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("c").alias("m"))
            nxt = colour.join(pushed, F.col("node") == F.col("dst"), "left").select("node", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.col("m") > F.col("c")).alias("moved"))
            colour = cut(nxt)
            if colour.filter("moved").isEmpty():
                break
            colour = colour.drop("moved")
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cd"))
        inside = live.join(a, "src").join(b, "dst").filter("cs = cd")
        back = closure(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.filter("node = c").select(F.col("c").alias("root"), "node"))
        part = cut(back.select("node", "root"))
        ids = part.groupBy("root").agg(F.min("node").alias("scc_id"))
        found = found.unionByName(part.join(ids, "root").select("node", "scc_id"))
        gone = part.select("node")
        live = cut(live.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti"))
    return found


def acyclic(edges: DataFrame) -> bool:
    """Whether peeling nodes without an incoming edge, round by round, leaves nothing."""
    live = cut(edges.select("src", "dst").distinct())
    while not live.isEmpty():
        kept = cut(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        if kept.count() == live.count():
            return False
        live = kept
    return True


def paths(edges: DataFrame, seeds: DataFrame, most_edges: int) -> DataFrame:
    """(root, path): simple paths from seeds (root) of at most so many edges, the bound being the query's own."""
    front = seeds.select("root", F.array("root").alias("path"))
    out = front
    for _ in range(most_edges):
        front = front.join(edges, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select("root", F.concat("path", F.array("dst")).alias("path"))
        out = out.unionByName(front)
    return out
