"""Queries over control flow: event types of a user as blocks, consecutive events as edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import bdd, flow, uml
from graphloom.operators.callgraph import as_edges
from graphloom.operators.closure import closure, scc, scc_levels
from graphloom.plans.projections import projected, table, with_ctes
from graphloom.plans.registry import query


def blocks(spark, sf):
    return projected(spark, sf, "blocks").select("fn_sym", F.col("block").cast("long").alias("block"), "is_exit", "n_stmts", "first_ord", "last_ord", "event_type")


def edges(spark, sf):
    return projected(spark, sf, "cfg_edges").select("fn_sym", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def graphs(spark, sf):
    return flow.graphs(blocks(spark, sf), edges(spark, sf))


#: away(fn, gone, node): blocks that the entry reaches without passing `gone`; -1 takes nothing away.
_AWAY = """, gone AS (SELECT fn_sym, block AS g FROM blocks UNION ALL SELECT DISTINCT fn_sym, -1 FROM blocks),
away AS (SELECT fn_sym, g, CAST(0 AS BIGINT) AS node FROM gone WHERE g <> 0 UNION SELECT a.fn_sym, a.g, e.dst FROM away a JOIN cfg_edges e ON e.fn_sym = a.fn_sym AND e.src = a.node AND e.dst <> a.g),
dominates AS (SELECT r.fn_sym, g.block AS d, r.node AS b FROM away r JOIN blocks g ON g.fn_sym = r.fn_sym WHERE r.g = -1 AND (g.block = r.node OR NOT EXISTS (SELECT 1 FROM away x WHERE x.fn_sym = r.fn_sym AND x.g = g.block AND x.node = r.node))),
strict AS (SELECT * FROM dominates WHERE d <> b),
idoms AS (SELECT fn_sym, b, d FROM strict s WHERE NOT EXISTS (SELECT 1 FROM strict t WHERE t.fn_sym = s.fn_sym AND t.b = s.b AND t.d <> s.d AND EXISTS (SELECT 1 FROM strict u WHERE u.fn_sym = s.fn_sym AND u.b = t.d AND u.d = s.d)) UNION ALL SELECT DISTINCT fn_sym, 0, 0 FROM blocks)
"""


def _dom(body: str) -> str:
    return with_ctes("blocks cfg_edges", "", True).rstrip() + _AWAY + body


@query("cyclomatic", with_ctes("blocks cfg_edges", "SELECT b.fn_sym, greatest((SELECT count(*) FROM cfg_edges e WHERE e.fn_sym = b.fn_sym) - count(*) + 2, 1) AS cyclomatic FROM blocks b GROUP BY b.fn_sym"))
def _(spark, sf):
    return flow.cyclomatic(blocks(spark, sf), edges(spark, sf))


@query("idom", _dom("SELECT fn_sym, CAST(b AS BIGINT) AS block, CAST(d AS BIGINT) AS idom FROM idoms"))
def _(spark, sf):
    return flow.dominators(graphs(spark, sf)).select("fn_sym", F.col("block").cast("long").alias("block"), F.col("idom").cast("long").alias("idom"))


@query("dominance_frontier", _dom("SELECT DISTINCT x.fn_sym, CAST(x.d AS BIGINT) AS block, CAST(e.dst AS BIGINT) AS frontier FROM dominates x JOIN cfg_edges e ON e.fn_sym = x.fn_sym AND e.src = x.b WHERE NOT EXISTS (SELECT 1 FROM strict s WHERE s.fn_sym = x.fn_sym AND s.d = x.d AND s.b = e.dst)"))
def _(spark, sf):
    return flow.dominance_frontier(graphs(spark, sf)).select("fn_sym", F.col("block").cast("long").alias("block"), F.col("frontier").cast("long").alias("frontier"))


#: The same from the end: a common end behind all blocks without a way on.
_POST = with_ctes("blocks cfg_edges", "", True).rstrip() + """, back AS (SELECT fn_sym, dst AS src, src AS dst FROM cfg_edges UNION ALL SELECT fn_sym, 999, block FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM cfg_edges e WHERE e.fn_sym = b.fn_sym AND e.src = b.block)),
gone AS (SELECT fn_sym, block AS g FROM blocks UNION ALL SELECT DISTINCT fn_sym, -1 FROM blocks),
away AS (SELECT fn_sym, g, CAST(999 AS BIGINT) AS node FROM gone UNION SELECT a.fn_sym, a.g, e.dst FROM away a JOIN back e ON e.fn_sym = a.fn_sym AND e.src = a.node AND e.dst <> a.g),
strict AS (SELECT r.fn_sym, g.block AS d, r.node AS b FROM away r JOIN blocks g ON g.fn_sym = r.fn_sym WHERE r.g = -1 AND r.node <> 999 AND g.block <> r.node AND NOT EXISTS (SELECT 1 FROM away x WHERE x.fn_sym = r.fn_sym AND x.g = g.block AND x.node = r.node)),
ipdoms AS (SELECT r.fn_sym, r.node AS b, (SELECT s.d FROM strict s WHERE s.fn_sym = r.fn_sym AND s.b = r.node AND NOT EXISTS (SELECT 1 FROM strict t WHERE t.fn_sym = s.fn_sym AND t.b = s.b AND t.d <> s.d AND EXISTS (SELECT 1 FROM strict u WHERE u.fn_sym = s.fn_sym AND u.b = t.d AND u.d = s.d))) AS d FROM away r WHERE r.g = -1 AND r.node <> 999)
"""


@query("post_idom", _POST + "SELECT fn_sym, CAST(b AS BIGINT) AS block, CAST(d AS BIGINT) AS ipdom FROM ipdoms WHERE d IS NOT NULL")
def _(spark, sf):
    return flow.dominators(graphs(spark, sf)).filter("ipdom IS NOT NULL").select("fn_sym", F.col("block").cast("long").alias("block"), F.col("ipdom").cast("long").alias("ipdom"))


@query("cdg", _POST + """, pd AS (SELECT fn_sym, b, b AS d FROM ipdoms UNION ALL SELECT fn_sym, b, d FROM strict)
SELECT DISTINCT e.fn_sym, CAST(e.src AS BIGINT) AS controller, CAST(p.d AS BIGINT) AS dependent FROM cfg_edges e JOIN pd p ON p.fn_sym = e.fn_sym AND p.b = e.dst WHERE EXISTS (SELECT 1 FROM ipdoms i WHERE i.fn_sym = e.fn_sym AND i.b = e.src) AND NOT EXISTS (SELECT 1 FROM strict s WHERE s.fn_sym = e.fn_sym AND s.b = e.src AND s.d = p.d)
  AND (SELECT count(*) FROM cfg_edges f WHERE f.fn_sym = e.fn_sym AND f.src = e.src) > 1""")
def _(spark, sf):
    return flow.cdg(graphs(spark, sf)).select("fn_sym", F.col("controller").cast("long").alias("controller"), F.col("dependent").cast("long").alias("dependent"))


@query("reverse_postorder")
def _(spark, sf):
    return flow.rpo(graphs(spark, sf))


@query("loops", _dom(""", backs AS (SELECT e.fn_sym, e.src, e.dst AS h FROM cfg_edges e JOIN dominates x ON x.fn_sym = e.fn_sym AND x.d = e.dst AND x.b = e.src),
body AS (SELECT fn_sym, h, src AS b FROM backs UNION SELECT y.fn_sym, y.h, e.src FROM body y JOIN cfg_edges e ON e.fn_sym = y.fn_sym AND e.dst = y.b WHERE y.b <> y.h AND EXISTS (SELECT 1 FROM away r WHERE r.fn_sym = e.fn_sym AND r.g = -1 AND r.node = e.src))
SELECT DISTINCT fn_sym, CAST(h AS BIGINT) AS header, CAST(b AS BIGINT) AS block FROM body"""))
def _(spark, sf):
    return flow.loops(graphs(spark, sf)).select("fn_sym", F.col("header").cast("long").alias("header"), F.col("block").cast("long").alias("block"))


@query("cfg_invariants", with_ctes("blocks", "SELECT fn_sym FROM blocks GROUP BY fn_sym HAVING count(*) FILTER (WHERE is_exit AND fn_sym % 7 <> 3) <> 1"))
def _(spark, sf):
    """Every seventh function is given no exit; those and no others are reported."""
    b = blocks(spark, sf).withColumn("is_exit", F.col("is_exit") & (F.col("fn_sym") % 7 != 3))
    dom = flow.dominators(graphs(spark, sf))
    return flow.bad_graphs(b, dom).select("fn_sym").distinct()


@query("activity_node_kind", with_ctes("blocks cfg_edges", "SELECT fn_sym, CAST(block AS BIGINT) AS block, CASE WHEN block = 0 THEN 'INITIAL' WHEN is_exit OR n_out = 0 THEN 'FINAL' WHEN n_in >= 2 AND n_out = 1 THEN 'MERGE' WHEN n_out = 2 THEN 'DECISION' ELSE 'ACTION' END AS kind FROM (SELECT b.*, (SELECT count(*) FROM cfg_edges e WHERE e.fn_sym = b.fn_sym AND e.src = b.block) AS n_out, (SELECT count(*) FROM cfg_edges e WHERE e.fn_sym = b.fn_sym AND e.dst = b.block) AS n_in FROM blocks b)"))
def _(spark, sf):
    return uml.activity_nodes(flow.degrees(blocks(spark, sf), edges(spark, sf)))


@query("uml_activities", _dom("SELECT e.fn_sym, CAST(e.src AS BIGINT) AS src, CAST(e.dst AS BIGINT) AS dst, EXISTS (SELECT 1 FROM dominates x WHERE x.fn_sym = e.fn_sym AND x.d = e.dst AND x.b = e.src) AS is_back FROM cfg_edges e"))
def _(spark, sf):
    dom = flow.dominators(graphs(spark, sf)).select("fn_sym", F.col("block").cast("long").alias("block"), F.col("idom").cast("long").alias("idom"))
    up = dom.filter("block <> idom").select(F.struct("fn_sym", F.col("block").alias("b")).alias("src"), F.struct("fn_sym", F.col("idom").alias("b")).alias("dst"))
    key = F.struct("fn_sym", F.col("block").alias("b"))
    every = closure(up, dom.select(key.alias("root"), key.alias("node"))).select("root.fn_sym", F.col("root.b").alias("block"), F.col("node.b").alias("dominator"))
    return uml.activity_edges(edges(spark, sf), every)


@query("block_of_stmt", with_ctes("steps blocks", "SELECT s.fn_sym, s.event_id AS stmt, CAST(b.block AS BIGINT) AS block FROM steps s JOIN blocks b ON b.fn_sym = s.fn_sym AND b.event_type = s.event_type"))
def _(spark, sf):
    held = projected(spark, sf, "steps").groupBy("fn_sym", "event_type").agg(F.collect_list("event_id").alias("stmts"))
    return blocks(spark, sf).join(held, ["fn_sym", "event_type"]).select("fn_sym", F.explode("stmts").alias("stmt"), "block")


# statements: a block sets the variable of its number's parity (errors and the exit set none) and reads what its event type says

_DEFS = "CASE WHEN event_type IN ('error', '~end') THEN NULL WHEN block % 2 = 0 THEN 'even' ELSE 'odd' END"
_USES = "(SELECT fn_sym, CAST(block AS BIGINT) AS block, 'even' AS var FROM blocks WHERE event_type IN ('click', 'purchase') UNION ALL SELECT fn_sym, CAST(block AS BIGINT), 'odd' FROM blocks WHERE event_type IN ('view', 'purchase'))"
#: live(fn_sym, block, var): read here, or live in a block behind and not set here.
_LIVE = f""", own AS (SELECT fn_sym, CAST(block AS BIGINT) AS block, {_DEFS} AS def FROM blocks),
live AS (SELECT * FROM {_USES} u UNION SELECT o.fn_sym, o.block, l.var FROM live l JOIN cfg_edges e ON e.fn_sym = l.fn_sym AND e.dst = l.block JOIN own o ON o.fn_sym = e.fn_sym AND o.block = e.src AND (o.def IS NULL OR o.def <> l.var))
"""


def statements(spark, sf):
    b = blocks(spark, sf)
    uses = F.when(F.col("event_type") == "click", F.array(F.lit("even"))).when(F.col("event_type") == "view", F.array(F.lit("odd"))).when(F.col("event_type") == "purchase", F.array(F.lit("even"), F.lit("odd"))).otherwise(F.array().cast("array<string>"))
    made = F.expr(_DEFS)
    return b.select("fn_sym", F.col("block").alias("stmt"), "block", uses.alias("uses"), F.when(made.isNull(), F.array().cast("array<string>")).otherwise(F.array(made)).alias("defs"))


def ssa(spark, sf):
    return flow.with_statements(graphs(spark, sf), statements(spark, sf))


@query("stmt_uses_defs", with_ctes("blocks", f"SELECT fn_sym, block AS stmt, var AS name, 'use' AS what FROM {_USES} u UNION ALL SELECT fn_sym, CAST(block AS BIGINT), {_DEFS}, 'def' FROM blocks WHERE {_DEFS} IS NOT NULL"))
def _(spark, sf):
    s = ssa(spark, sf).select("fn_sym", F.explode("stmts").alias("s"))
    return s.select("fn_sym", "s.stmt", F.explode("s.uses").alias("name"), F.lit("use").alias("what")).unionByName(s.select("fn_sym", "s.stmt", F.explode("s.defs").alias("name"), F.lit("def").alias("what")))


@query("liveness", with_ctes("blocks cfg_edges", "", True).rstrip() + _LIVE + """, out_ AS (SELECT DISTINCT e.fn_sym, CAST(e.src AS BIGINT) AS block, l.var FROM cfg_edges e JOIN live l ON l.fn_sym = e.fn_sym AND l.block = e.dst)
SELECT coalesce(i.fn_sym, o.fn_sym) AS fn_sym, coalesce(i.block, o.block) AS block, coalesce(i.var, o.var) AS var, i.var IS NOT NULL AS live_in, o.var IS NOT NULL AS live_out FROM live i FULL JOIN out_ o ON i.fn_sym = o.fn_sym AND i.block = o.block AND i.var = o.var""")
def _(spark, sf):
    return flow.liveness(ssa(spark, sf)).select("fn_sym", F.col("block").cast("long").alias("block"), "var", "live_in", "live_out")


@query("place_phi", with_ctes("blocks cfg_edges", "", True).rstrip() + _AWAY + _LIVE + """, df AS (SELECT DISTINCT x.fn_sym, x.d AS b, e.dst AS f FROM dominates x JOIN cfg_edges e ON e.fn_sym = x.fn_sym AND e.src = x.b WHERE NOT EXISTS (SELECT 1 FROM strict s WHERE s.fn_sym = x.fn_sym AND s.d = x.d AND s.b = e.dst)),
phi AS (SELECT d.fn_sym, o.def AS var, d.f AS block FROM df d JOIN own o ON o.fn_sym = d.fn_sym AND o.block = d.b AND o.def IS NOT NULL JOIN live l ON l.fn_sym = d.fn_sym AND l.block = d.f AND l.var = o.def UNION SELECT p.fn_sym, p.var, d.f FROM phi p JOIN df d ON d.fn_sym = p.fn_sym AND d.b = p.block JOIN live l ON l.fn_sym = d.fn_sym AND l.block = d.f AND l.var = p.var)
SELECT fn_sym, var, CAST(block AS BIGINT) AS block FROM phi""")
def _(spark, sf):
    return flow.phis(ssa(spark, sf)).select("fn_sym", "var", F.col("block").cast("long").alias("block"))


@query("ssa_version")
def _(spark, sf):
    return flow.ssa_defs(ssa(spark, sf))


@query("rename")
def _(spark, sf):
    return flow.def_use(ssa(spark, sf))


@query("ssa_invariants", with_ctes("blocks", f"SELECT fn_sym, CAST(0 AS BIGINT) AS ssa_id FROM blocks GROUP BY fn_sym HAVING fn_sym % 5 = 1 AND count({_DEFS}) > 0"))
def _(spark, sf):
    """In every fifth function the first definition is there twice; those and no others are reported."""
    g = ssa(spark, sf)
    defs = flow.ssa_defs(g)
    twice = defs.unionByName(defs.filter("fn_sym % 5 = 1 AND ssa_id = 0"))
    return flow.bad_ssa(twice, flow.phis(g), edges(spark, sf).withColumn("dst", F.col("dst").cast("int")))


def _facts(analysis: str, source: str):
    """Source facts at statements of the first block of some functions, carried along def-use."""

    def run(spark, sf):
        g = ssa(spark, sf)
        defs, uses = flow.ssa_defs(g), flow.def_use(g)
        made = defs.filter("NOT is_phi").select("fn_sym", F.col("def_stmt").alias("use_stmt"), F.col("ssa_id").alias("dst"))
        flows = uses.join(made, ["fn_sym", "use_stmt"]).select("fn_sym", F.col("ssa_id").alias("src"), "dst")
        seeds = defs.filter("def_stmt = 0").filter(source).select("fn_sym", "ssa_id", F.lit(analysis).alias("analysis"), F.lit("source").alias("value"))
        return flow.facts(defs, seeds, flows)

    return run


query("taint")(_facts("taint", "fn_sym % 2 = 0"))
query("nullable")(_facts("nullable", "fn_sym % 3 = 0"))
query("type_state")(_facts("type_state", "fn_sym % 5 = 0"))


@query("max_path_len")
def _(spark, sf):
    return flow.path_lengths(graphs(spark, sf))


@query("sat_count")
def _(spark, sf):
    return bdd.path_metrics(graphs(spark, sf))


@query("bdd_nodes")
def _(spark, sf):
    return bdd.bdd_nodes(graphs(spark, sf))


#: Every way along edges to a later block, and whether it can go on.
_WAYS = with_ctes("blocks cfg_edges", "", True).rstrip() + """, on_ AS (SELECT * FROM cfg_edges WHERE dst > src),
ways AS (SELECT fn_sym, block AS node, 1 AS n FROM blocks WHERE block = 0 UNION ALL SELECT w.fn_sym, e.dst, w.n + 1 FROM ways w JOIN on_ e ON e.fn_sym = w.fn_sym AND e.src = w.node)
"""


@query("path_count", _WAYS + "SELECT fn_sym, CAST(max(n) AS BIGINT) AS max_path_len, CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM on_ e WHERE e.fn_sym = w.fn_sym AND e.src = w.node)) AS BIGINT) AS acyclic_path_count FROM ways w GROUP BY fn_sym")
def _(spark, sf):
    """Over edges to later blocks, so that every way ends and SQL can walk them all."""
    found = flow.path_lengths(flow.graphs(blocks(spark, sf), edges(spark, sf).filter("dst > src")))
    return found.select("fn_sym", F.col("max_path_len").cast("long").alias("max_path_len"), F.col("acyclic_path_count").cast("long").alias("acyclic_path_count"))


_RECURSIVE = with_ctes("call_edges", "", True).rstrip() + ",\nreach AS (SELECT caller AS root, callee AS node FROM call_edges UNION SELECT r.root, e.callee FROM reach r JOIN call_edges e ON e.caller = r.node)\n"


@query("recursive_unwind", _RECURSIVE + "SELECT root AS sym, CAST(3 AS BIGINT) AS unwind_depth FROM reach WHERE root = node")
def _(spark, sf):
    e = as_edges(projected(spark, sf, "call_edges"))
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    return bdd.unwind_depths(scc(nodes, e)).filter("unwind_depth > 0").select("sym", "unwind_depth")


@query("scc_order", _RECURSIVE + """, every AS (SELECT caller AS node FROM call_edges UNION SELECT callee FROM call_edges),
ids AS (SELECT v.node, least(v.node, coalesce((SELECT min(a.node) FROM reach a JOIN reach b ON a.root = b.node AND a.node = b.root WHERE a.root = v.node), v.node)) AS scc_id FROM every v),
up AS (SELECT DISTINCT a.scc_id AS x, b.scc_id AS y FROM call_edges e JOIN ids a ON a.node = e.caller JOIN ids b ON b.node = e.callee WHERE a.scc_id <> b.scc_id),
deep AS (SELECT scc_id, 0 AS level FROM ids UNION SELECT u.x, d.level + 1 FROM deep d JOIN up u ON u.y = d.scc_id)
SELECT scc_id, CAST(max(level) AS BIGINT) AS level FROM deep GROUP BY scc_id""")
def _(spark, sf):
    """Components of the call graph by how many others lie below them: callees come before their callers."""
    e = as_edges(projected(spark, sf, "call_edges"))
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    return scc_levels(scc(nodes, e), e)
