"""Queries over symbols, hierarchy, calls, traces and UML records."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.scalar import KEYWORDS, classify_token
from graphloom.operators import callgraph as C
from graphloom.operators import closure as L
from graphloom.operators import symbols as Y
from graphloom.operators import trace as R
from graphloom.operators import uml as U
from graphloom.plans.projections import projected, table, with_ctes
from graphloom.plans.q_tokens import _sql_in, lexed
from graphloom.plans.registry import query

_CLASS = "kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD')"


def S(spark, sf):
    return projected(spark, sf, "symbols")


def E(spark, sf):
    return projected(spark, sf, "call_edges")


def H(spark, sf):
    return projected(spark, sf, "th_edges")


def roots(spark, sf, kind="METHOD"):
    return S(spark, sf).filter(f"kind = '{kind}'").select(F.col("sym_id").alias("root"))


@query("sym_by_node", with_ctes("symbols", "SELECT o_orderkey AS node_id, sym_id FROM orders JOIN symbols ON sym_id = 10000000 + o_orderkey"))
def _(spark, sf):
    nodes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node_id"))
    return Y.by_node(nodes, S(spark, sf).filter("kind = 'METHOD'").withColumn("decl_node", F.col("sym_id") - 10000000))


@query("sym_children", with_ctes("symbols", "SELECT parent_sym, sym_id, kind FROM symbols WHERE parent_sym IS NOT NULL"))
def _(spark, sf):
    return Y.children(S(spark, sf))


_CHAIN = """chain AS (SELECT sym_id AS scope_id, sym_id AS outer_id, 0 AS dist FROM symbols WHERE kind <> 'METHOD' AND kind <> 'FIELD' UNION ALL SELECT c.scope_id, s.parent_sym, c.dist + 1 FROM chain c JOIN symbols s ON s.sym_id = c.outer_id WHERE s.parent_sym IS NOT NULL)"""


def _chain(body: str) -> str:
    return with_ctes("symbols", "", True).rstrip() + ",\n" + _CHAIN + "\n" + body


def scopes(spark, sf):
    return S(spark, sf).filter("kind NOT IN ('METHOD', 'FIELD')").select(F.col("sym_id").alias("scope_id"), F.col("parent_sym").alias("parent_scope"))


@query("scope_chain", _chain("SELECT scope_id, outer_id, CAST(dist AS BIGINT) AS dist FROM chain"))
def _(spark, sf):
    return Y.scope_chain(scopes(spark, sf)).withColumnRenamed("outer", "outer_id")


# uses: each order asks, from its customer, for a nation's name; nations are declared in regions
_USES = "uses AS (SELECT o_orderkey AS use_id, 1000000 + o_custkey AS scope_id, lower(n_name) AS name FROM orders JOIN nation ON n_nationkey = o_orderkey % 25)"


def uses(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lower("n_name").alias("name"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("use_id"), (F.col("o_custkey") + 1000000).alias("scope_id"), (F.col("o_orderkey") % 25).alias("k")).join(F.broadcast(n), "k").drop("k")


@query("resolve_lexical", _chain(f"""SELECT u.use_id, r.sym_id FROM ({_USES.split('AS (', 1)[1][:-1]}) u LEFT JOIN (SELECT use_id, arg_min(d.sym_id, (c.dist, d.ordinal, d.sym_id)) AS sym_id FROM ({_USES.split('AS (', 1)[1][:-1]}) v JOIN chain c ON c.scope_id = v.scope_id JOIN symbols d ON d.parent_sym = c.outer_id AND d.name = v.name AND d.kind = 'PACKAGE' GROUP BY use_id) r USING (use_id)"""))
def _(spark, sf):
    declared = S(spark, sf).filter("kind = 'PACKAGE' AND parent_sym IS NOT NULL").select(F.col("parent_sym").alias("scope_id"), "name", "sym_id", "ordinal")
    return Y.resolve_lexical(uses(spark, sf), scopes(spark, sf), declared).select("use_id", "sym_id")


_IMPORTS = "SELECT CAST(100 + n_nationkey AS BIGINT) AS scope_id, lower(n_name) AS simple_name, concat('org.', lower(n_name)) AS qual_name, n_nationkey % 3 = 0 AS is_wildcard FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), lower(n_name), concat('net.', lower(n_name)), false FROM region JOIN nation ON n_nationkey % 5 = r_regionkey"


def imports(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    a = n.select((F.col("n_nationkey") + 100).cast("long").alias("scope_id"), F.lower("n_name").alias("simple_name"), F.concat(F.lit("org."), F.lower("n_name")).alias("qual_name"), (F.col("n_nationkey") % 3 == 0).alias("is_wildcard"))
    b = r.join(n, F.col("n_nationkey") % 5 == F.col("r_regionkey")).select(F.col("r_regionkey").cast("long").alias("scope_id"), F.lower("n_name").alias("simple_name"), F.concat(F.lit("net."), F.lower("n_name")).alias("qual_name"), F.lit(False).alias("is_wildcard"))
    return a.unionByName(b)


_IMPORTED = f"SELECT v.use_id, arg_min(i.qual_name, (c.dist, i.qual_name)) AS qual_name FROM ({_USES.split('AS (', 1)[1][:-1]}) v JOIN chain c ON c.scope_id = v.scope_id JOIN ({_IMPORTS}) i ON i.scope_id = c.outer_id AND i.simple_name = v.name AND NOT i.is_wildcard GROUP BY v.use_id"


@query("resolve_import", _chain(f"SELECT u.use_id, r.qual_name FROM ({_USES.split('AS (', 1)[1][:-1]}) u LEFT JOIN ({_IMPORTED}) r USING (use_id)"))
def _(spark, sf):
    return Y.resolve_import(uses(spark, sf), scopes(spark, sf), imports(spark, sf)).select("use_id", "qual_name")


@query("wildcard_imports", _chain(f"SELECT DISTINCT c.scope_id, i.qual_name FROM chain c JOIN ({_IMPORTS}) i ON i.scope_id = c.outer_id AND i.is_wildcard"))
def _(spark, sf):
    return Y.wildcard_imports(scopes(spark, sf), imports(spark, sf))


_TNAME = "CASE p_partkey % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'List' WHEN 2 THEN 'Local' WHEN 3 THEN 'Imported' WHEN 4 THEN 'String' ELSE p_brand END"


@query("resolve_type", f"""SELECT p_partkey AS use_id, t AS name, CASE WHEN t = 'int' THEN 'primitive' WHEN t = 'Local' THEN 'lexical' WHEN t = 'Imported' THEN 'import' WHEN t IN ('List', 'String') THEN 'stub' ELSE 'external' END AS how,
  CASE WHEN t = 'Local' THEN CAST(p_partkey AS VARCHAR) WHEN t = 'Imported' THEN concat('org.', p_partkey) WHEN t = 'List' THEN 'java.util.List' WHEN t = 'String' THEN 'java.lang.String' ELSE t END AS target FROM (SELECT p_partkey, {_TNAME} AS t FROM part)""")
def _(spark, sf):
    u = table(spark, sf, "part").select(F.col("p_partkey").alias("use_id"), F.expr(_TNAME).alias("name"))
    lexical = u.filter("name IN ('Local', 'int')").select("use_id", F.col("use_id").alias("sym_id"))
    imported = u.filter("name IN ('Imported', 'Local')").select("use_id", F.concat(F.lit("org."), "use_id").alias("qual_name"))
    return Y.resolve_type(u, lexical, imported)


@query("assign_member_type", "SELECT l_orderkey AS sym_id, arg_min(l_partkey, (l_linenumber, l_partkey)) AS type FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    return Y.member_types(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sym_id"), F.col("l_linenumber").alias("pre"), F.col("l_partkey").alias("type")))


@query("count_params", "SELECT o_orderkey AS sym_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sym_id"), F.lit("METHOD").alias("kind"), F.lit(None).cast("long").alias("parent_sym"))
    p = table(spark, sf, "lineitem").select((-F.col("l_orderkey") * 8 - F.col("l_linenumber")).alias("sym_id"), F.lit("PARAM").alias("kind"), F.col("l_orderkey").alias("parent_sym"))
    return Y.count_params(m.unionByName(p))


@query("count_args", with_ctes("call_sites", "SELECT site_id, greatest(n_children - 1, 0) AS arg_count FROM call_sites"))
def _(spark, sf):
    return C.count_args(projected(spark, sf, "call_sites"))


@query("unique_call_edges", with_ctes("call_sites", "SELECT caller, callee, min(site_id) AS site_id, arg_min(edge_type, site_id) AS edge_type FROM call_sites GROUP BY caller, callee"))
def _(spark, sf):
    return C.unique_edges(projected(spark, sf, "call_sites"))


@query("callee_adj", with_ctes("call_edges", "SELECT caller AS sym, string_agg(CAST(callee AS VARCHAR), ',' ORDER BY callee) AS neighbours, count(*) AS n FROM call_edges GROUP BY caller"))
def _(spark, sf):
    return C.adjacency(E(spark, sf)).select("sym", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"), "n")


@query("caller_adj", with_ctes("call_edges", "SELECT callee AS sym, string_agg(CAST(caller AS VARCHAR), ',' ORDER BY caller) AS neighbours, count(*) AS n FROM call_edges GROUP BY callee"))
def _(spark, sf):
    return C.adjacency(E(spark, sf), "callee").select("sym", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"), "n")


@query("fan_in_zero", with_ctes("symbols call_edges", "SELECT sym_id FROM symbols WHERE kind = 'METHOD' AND visibility IN ('public', 'package') AND sym_id NOT IN (SELECT callee FROM call_edges)"))
def _(spark, sf):
    return C.entry_points(S(spark, sf), E(spark, sf))


_SUB = "sub AS (SELECT DISTINCT to_sym AS root, to_sym AS node FROM th_edges WHERE relation <> 'USES' UNION SELECT s.root, e.from_sym FROM sub s JOIN th_edges e ON e.to_sym = s.node AND e.relation <> 'USES')"


@query("subtypes_of", with_ctes("th_edges", "", True).rstrip() + ",\n" + _SUB + "\nSELECT root, node FROM sub")
def _(spark, sf):
    h = H(spark, sf)
    return Y.subtypes(h, h.filter("relation <> 'USES'").select(F.col("to_sym").alias("root")).distinct()).select("root", "node")


@query("supertypes_of", with_ctes("th_edges", "", True).rstrip() + ",\nsup AS (SELECT DISTINCT from_sym AS root, from_sym AS node FROM th_edges WHERE relation <> 'USES' UNION SELECT s.root, e.to_sym FROM sup s JOIN th_edges e ON e.from_sym = s.node AND e.relation <> 'USES')\nSELECT root, node FROM sup")
def _(spark, sf):
    h = H(spark, sf)
    return Y.supertypes(h, h.filter("relation <> 'USES'").select(F.col("from_sym").alias("root")).distinct()).select("root", "node")


def cha_sites(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("site_id"), (F.col("o_custkey") + 1000000).alias("type_sym"), F.lit("getInstance").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 10000000).alias("target"))


_CHA = with_ctes("symbols th_edges", "", True).rstrip() + ",\n" + """sub AS (SELECT sym_id AS root, sym_id AS node FROM symbols WHERE kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD') UNION SELECT s.root, e.from_sym FROM sub s JOIN th_edges e ON e.to_sym = s.node AND e.relation <> 'USES'),
sites AS (SELECT o_orderkey AS site_id, 1000000 + o_custkey AS type_sym, CASE WHEN o_orderkey % 2 = 0 THEN 10000000 + o_orderkey END AS target FROM orders WHERE o_orderstatus = 'O'),
found AS (SELECT DISTINCT site_id, m.sym_id AS callee FROM sites JOIN sub ON root = type_sym JOIN symbols m ON m.parent_sym = node AND m.kind = 'METHOD' AND NOT m.is_abstract AND m.name = 'getInstance'),
cha AS (SELECT site_id, callee, false AS is_fallback FROM found UNION ALL SELECT site_id, target, true FROM sites WHERE target IS NOT NULL AND site_id NOT IN (SELECT site_id FROM found))"""


@query("resolve_cha", _CHA + "\nSELECT site_id, callee, is_fallback FROM cha")
def _(spark, sf):
    return C.resolve_cha(cha_sites(spark, sf), S(spark, sf), H(spark, sf))


@query("points_to", """WITH RECURSIVE alloc AS (SELECT l_orderkey AS fn_sym, l_linenumber AS var, l_suppkey AS type_sym FROM lineitem WHERE l_linenumber % 2 = 1), copies AS (SELECT a.l_orderkey AS fn_sym, a.l_linenumber AS src, b.l_linenumber AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_returnflag <> 'A'),
pt AS (SELECT fn_sym, var, type_sym FROM alloc UNION SELECT p.fn_sym, c.dst, p.type_sym FROM pt p JOIN copies c ON c.fn_sym = p.fn_sym AND c.src = p.var) SELECT fn_sym, CAST(var AS BIGINT) AS var, type_sym FROM pt""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    alloc = li.filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("fn_sym"), F.col("l_linenumber").alias("var"), F.col("l_suppkey").alias("type_sym"))
    nxt = li.select("l_orderkey", F.col("l_linenumber").alias("dst"))
    copies = li.filter("l_returnflag <> 'A'").select("l_orderkey", F.col("l_linenumber").alias("src")).join(nxt, "l_orderkey").filter("dst = src + 1").select(F.col("l_orderkey").alias("fn_sym"), "src", "dst")
    return C.points_to(alloc, copies).select("fn_sym", F.col("var").cast("long").alias("var"), "type_sym")


@query("resolve_1cfa", "SELECT DISTINCT o_orderkey AS site_id, 10000000 + o2 AS callee FROM orders JOIN (SELECT o_orderkey AS o2, o_custkey AS c2 FROM orders) x ON c2 = o_custkey AND o2 % 8 = o_orderkey % 8")
def _(spark, sf):
    o = table(spark, sf, "orders")
    name = lambda: F.concat(F.lit("m"), F.col("o_orderkey") % 8)
    methods = o.select((F.col("o_orderkey") + 10000000).alias("sym_id"), name().alias("name"), F.lit("METHOD").alias("kind"), (F.col("o_custkey") + 1000000).alias("parent_sym"))
    sites = o.select(F.col("o_orderkey").alias("site_id"), F.col("o_orderkey").alias("fn_sym"), F.lit(0).alias("receiver"), name().alias("name"))
    pts = o.select(F.col("o_orderkey").alias("fn_sym"), F.lit(0).alias("var"), (F.col("o_custkey") + 1000000).alias("type_sym"))
    return C.resolve_1cfa(sites, pts, methods)


@query("resolve_call_site", _CHA + """, one AS (SELECT site_id, min(callee) AS callee FROM cha WHERE site_id % 3 = 0 GROUP BY site_id), typed AS (SELECT *, CASE site_id % 5 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'INTERFACE' ELSE 'VIRTUAL' END AS call_type FROM sites)
SELECT site_id, target AS callee, call_type AS edge_type FROM typed WHERE call_type = 'DIRECT' AND target IS NOT NULL
UNION ALL SELECT t.site_id, o.callee, t.call_type FROM typed t JOIN one o USING (site_id) WHERE t.call_type <> 'DIRECT'
UNION ALL SELECT t.site_id, c.callee, t.call_type FROM typed t JOIN cha c USING (site_id) WHERE t.call_type <> 'DIRECT' AND t.site_id NOT IN (SELECT site_id FROM one)""")
def _(spark, sf):
    sites = cha_sites(spark, sf)
    cha = C.resolve_cha(sites, S(spark, sf), H(spark, sf))
    one = cha.filter("site_id % 3 = 0").groupBy("site_id").agg(F.min("callee").alias("callee"))
    typed = sites.withColumn("call_type", F.when(F.col("site_id") % 5 == 0, "DIRECT").when(F.col("site_id") % 5 == 1, "INTERFACE").otherwise("VIRTUAL"))
    return C.resolve_sites(typed, one, cha)


_REACH = with_ctes("call_edges", "", True).rstrip() + ",\nreach AS (SELECT DISTINCT caller AS root, caller AS node FROM call_edges UNION SELECT r.root, e.callee FROM reach r JOIN call_edges e ON e.caller = r.node)\n"


@query("is_reachable", _REACH.replace("SELECT DISTINCT caller AS root, caller AS node FROM call_edges UNION", "SELECT DISTINCT 10000000 + o_orderkey AS root, 10000000 + o_orderkey AS node FROM orders UNION") + "SELECT s, t, EXISTS (SELECT 1 FROM reach WHERE root = s AND node = t) AS reachable FROM (SELECT 10000000 + o_orderkey AS s, 10000000 + o_orderkey + o_orderkey % 40 AS t FROM orders)")
def _(spark, sf):
    pairs = table(spark, sf, "orders").select((F.col("o_orderkey") + 10000000).alias("s"), (F.col("o_orderkey") + 10000000 + F.col("o_orderkey") % 40).alias("t"))
    return C.is_reachable(E(spark, sf), pairs)


@query("matched_reachable")
def _(spark, sf):
    e = L.cut(E(spark, sf).select("site_id", "caller", "callee"))
    calls = e.select("site_id", F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit(False).alias("is_return")).unionByName(e.select("site_id", F.col("callee").alias("src"), F.col("caller").alias("dst"), F.lit(True).alias("is_return")))
    every = S(spark, sf).filter("kind = 'METHOD'").select(F.col("sym_id").alias("root"))
    # the nodes are whole methods, so there are no flows within one
    return C.matched_reachable(calls, e.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).limit(0), every)


def _bfs(start: str, step: str, depth: int | None) -> str:
    bound = f" AND r.dist < {depth}" if depth else ""
    if depth:
        return f"walk AS ({start} UNION ALL SELECT DISTINCT r.root, {step}, r.dist + 1 FROM walk r JOIN steps_ e ON e.src = r.node{bound})\nSELECT root, node, CAST(min(dist) AS BIGINT) AS dist FROM walk GROUP BY root, node"
    return f"walk AS ({start} UNION SELECT r.root, {step} FROM walk r JOIN steps_ e ON e.src = r.node)\nSELECT root, node FROM walk"


_ROOTS = "SELECT sym_id AS root, sym_id AS node{d} FROM symbols WHERE kind = 'METHOD'"


@query("forward_slice", with_ctes("symbols call_edges", "", True).rstrip() + ",\nsteps_ AS (SELECT caller AS src, callee AS dst FROM call_edges),\n" + _bfs(_ROOTS.format(d=", 0 AS dist"), "e.dst", 3))
def _(spark, sf):
    return C.forward_slice(E(spark, sf), roots(spark, sf), 3)


@query("backward_slice", with_ctes("symbols call_edges", "", True).rstrip() + ",\nsteps_ AS (SELECT callee AS src, caller AS dst FROM call_edges UNION ALL SELECT sym_id, parent_sym FROM symbols WHERE parent_sym IS NOT NULL),\n" + _bfs(_ROOTS.format(d=", 0 AS dist"), "e.dst", 3))
def _(spark, sf):
    return C.backward_slice(E(spark, sf), S(spark, sf), roots(spark, sf), 3)


@query("impact_set", with_ctes("symbols call_edges", "", True).rstrip() + ",\nsteps_ AS (SELECT callee AS src, caller AS dst FROM call_edges),\n" + _bfs(_ROOTS.format(d=""), "e.dst", None))
def _(spark, sf):
    return C.impact_set(E(spark, sf), roots(spark, sf)).select("root", "node")


@query("scc", _REACH + ", mutual AS (SELECT a.root, a.node FROM reach a JOIN reach b ON a.root = b.node AND a.node = b.root), ids AS (SELECT root AS node, min(node) AS scc_id, count(*) AS scc_size FROM mutual GROUP BY root), every AS (SELECT 10000000 + o_orderkey AS node FROM orders)\nSELECT v.node, coalesce(i.scc_id, v.node) AS scc_id, coalesce(i.scc_size, 1) AS scc_size, CASE WHEN i.scc_size > 1 THEN 2 WHEN v.node IN (SELECT caller FROM call_edges WHERE caller = callee) THEN 1 ELSE 0 END::BIGINT AS scc_class FROM every v LEFT JOIN ids i USING (node)")
def _(spark, sf):
    nodes = S(spark, sf).filter("kind = 'METHOD'").select(F.col("sym_id").alias("node"))
    return L.scc(nodes, C.as_edges(E(spark, sf)))


_UP = "SELECT from_sym AS src, to_sym AS dst FROM th_edges WHERE relation <> 'USES'"


@query("th_acyclic", with_ctes("th_edges", "", True).rstrip() + f""",
given AS (SELECT 'as it is' AS hierarchy, src, dst FROM ({_UP}) UNION ALL SELECT 'with an edge back', src, dst FROM ({_UP}) UNION ALL SELECT 'with an edge back', 1000000, 1000005),
above AS (SELECT hierarchy, src, dst FROM given UNION SELECT a.hierarchy, a.src, g.dst FROM above a JOIN given g ON g.hierarchy = a.hierarchy AND g.src = a.dst)
SELECT hierarchy, count(*) FILTER (WHERE src = dst) = 0 AS acyclic FROM above GROUP BY hierarchy""")
def _(spark, sf):
    """The hierarchy, and the same with the top class put below one of its own."""
    h = H(spark, sf).filter("relation <> 'USES'").select(F.col("from_sym").alias("src"), F.col("to_sym").alias("dst"))
    back = h.unionByName(spark.createDataFrame([(1000000, 1000005)], "src long, dst long"))
    return spark.createDataFrame([("as it is", L.acyclic(h)), ("with an edge back", L.acyclic(back))], "hierarchy string, acyclic boolean")


@query("all_paths", with_ctes("symbols call_edges", "", True).rstrip() + ",\nwalk AS (SELECT sym_id AS root, [sym_id] AS path FROM symbols WHERE kind = 'METHOD' UNION ALL SELECT w.root, list_append(w.path, e.callee) FROM walk w JOIN call_edges e ON e.caller = w.path[-1] WHERE NOT list_contains(w.path, e.callee) AND len(w.path) <= 3)\nSELECT root, array_to_string(path, ' ') AS path FROM walk")
def _(spark, sf):
    found = L.paths(C.as_edges(E(spark, sf)), roots(spark, sf), 3)
    return found.select("root", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


@query("coverage", with_ctes("call_edges", "SELECT count(*) AS n_edges, CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = caller - 10000000 AND l_returnflag = 'R')) AS BIGINT) AS n_covered FROM call_edges"))
def _(spark, sf):
    traced = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select((F.col("l_orderkey") + 10000000).alias("caller")).distinct().withColumn("hit", F.lit(1))
    return E(spark, sf).join(traced, "caller", "left").agg(F.count("*").alias("n_edges"), F.count("hit").alias("n_covered"))


@query("callers_of", with_ctes("call_edges", "SELECT callee AS sym, count(DISTINCT caller) AS n FROM call_edges GROUP BY callee"))
def _(spark, sf):
    return E(spark, sf).groupBy(F.col("callee").alias("sym")).agg(F.countDistinct("caller").alias("n"))


@query("callees_of", with_ctes("call_edges", "SELECT caller AS sym, count(DISTINCT callee) AS n FROM call_edges GROUP BY caller"))
def _(spark, sf):
    return E(spark, sf).groupBy(F.col("caller").alias("sym")).agg(F.countDistinct("callee").alias("n"))


@query("find_symbol", with_ctes("symbols", "SELECT sym_id, kind FROM symbols WHERE name = 'getInstance'"))
def _(spark, sf):
    return S(spark, sf).filter("name = 'getInstance'").select("sym_id", "kind")


@query("artifact_totals", with_ctes("symbols th_edges call_edges", "SELECT 'symbols' AS name, count(*) AS n FROM symbols UNION ALL SELECT 'th_edges', count(*) FROM th_edges UNION ALL SELECT 'call_edges', count(*) FROM call_edges"))
def _(spark, sf):
    from graphloom.operators.diagrams import counts

    return counts({"symbols": S(spark, sf), "th_edges": H(spark, sf), "call_edges": E(spark, sf)})


@query("qualified_names", with_ctes("symbols", "SELECT m.sym_id, concat_ws('.', r.name, n.name, c.name, m.name) AS qual_name FROM symbols m JOIN symbols c ON c.sym_id = m.parent_sym JOIN symbols n ON n.sym_id = c.parent_sym JOIN symbols r ON r.sym_id = n.parent_sym WHERE m.kind = 'METHOD'"))
def _(spark, sf):
    return Y.qualified_names(S(spark, sf)).filter("sym_id >= 10000000").select("sym_id", "qual_name")


@query("symbol_invariants", with_ctes("symbols th_edges", """SELECT sym_id, 'orphan' AS fault FROM symbols WHERE kind IN ('METHOD', 'FIELD') AND ordinal % 11 = 4
UNION ALL SELECT sym_id, 'name twice in its scope' FROM symbols WHERE kind = 'CLASS' AND ordinal % 13 = 5
UNION ALL SELECT from_sym, 'edge to nothing' FROM th_edges WHERE to_sym NOT IN (SELECT sym_id FROM symbols) GROUP BY from_sym
UNION ALL SELECT from_sym, 'edge to nothing' FROM th_edges WHERE from_sym % 17 = 6 AND to_sym IN (SELECT sym_id FROM symbols) GROUP BY from_sym"""))
def _(spark, sf):
    """Some members lose their parent, some classes are declared twice and some edges point nowhere; those and no others are reported."""
    s, h = S(spark, sf), H(spark, sf)
    lost = F.col("kind").isin("METHOD", "FIELD") & (F.col("ordinal") % 11 == 4)
    bad = s.withColumn("parent_sym", F.when(lost, -7).otherwise(F.col("parent_sym")))
    bad = bad.unionByName(bad.filter("kind = 'CLASS' AND ordinal % 13 = 5"))
    edges = h.withColumn("to_sym", F.when(F.col("from_sym") % 17 == 6, -7).otherwise(F.col("to_sym")))
    return Y.bad_symbols(bad, edges).distinct()


@query("build_hierarchy", with_ctes("symbols", "SELECT a.sym_id AS from_sym, b.sym_id AS to_sym, CASE WHEN b.kind = 'INTERFACE' AND a.kind <> 'INTERFACE' THEN 'IMPLEMENTS' ELSE 'EXTENDS' END AS relation FROM symbols a JOIN symbols b ON b.sym_id = 1000000 + a.ordinal * 7 % (SELECT count(*) FROM customer) WHERE a.sym_id >= 1000000 AND a.sym_id < 2000000"))
def _(spark, sf):
    n = table(spark, sf, "customer").count()
    s = S(spark, sf)
    supers = s.filter("sym_id >= 1000000 AND sym_id < 2000000").select("sym_id", (F.lit(1000000) + F.col("ordinal") * 7 % n).alias("super_sym"))
    return Y.hierarchy_edges(supers, s)


@query("detect_association", with_ctes("symbols", "SELECT f.parent_sym AS from_sym, f.type_sym AS to_sym, f.sym_id AS field_sym, CASE WHEN f.is_static AND f.ordinal % 2 = 0 THEN 'Composition' WHEN f.ordinal % 3 = 0 THEN 'Aggregation' ELSE 'Association' END AS kind, f.name AS role FROM symbols f WHERE f.kind = 'FIELD' AND f.type_sym IS NOT NULL".replace("WHEN f.is_static AND f.ordinal % 2 = 0 THEN 'Composition' WHEN f.ordinal % 3 = 0 THEN 'Aggregation'", "WHEN f.ordinal % 3 = 0 THEN 'Aggregation' WHEN f.is_static AND f.ordinal % 2 = 0 THEN 'Composition'")))
def _(spark, sf):
    s = S(spark, sf).withColumns({"is_final": F.col("is_static"), "is_array": F.col("ordinal") % 3 == 0, "made_in_constructor": F.col("ordinal") % 2 == 0})
    return Y.associations(s).select("from_sym", "to_sym", "field_sym", "kind", "role")


_BAD = [w for w in "if else for while do switch case break continue return throw try catch finally new instanceof class interface enum record".split()]


@query("class_candidates", with_ctes("symbols", rf"SELECT sym_id FROM symbols WHERE {_CLASS} AND regexp_full_match(name, '[A-Za-z0-9_]+') AND NOT (contains(name, '_') AND regexp_full_match(name, '[A-Z_0-9]+')) AND NOT name LIKE '%\_' ESCAPE '\' AND NOT name LIKE '%Binding' AND name NOT IN ({_sql_in(_BAD)}) AND regexp_matches(name, '^[A-Z]')"))
def _(spark, sf):
    return Y.class_candidates(S(spark, sf)).select("sym_id")


@query("class_owner_class", with_ctes("symbols call_edges", "SELECT e.site_id, a.parent_sym AS caller_class, b.parent_sym AS callee_class FROM call_edges e JOIN symbols a ON a.sym_id = e.caller JOIN symbols b ON b.sym_id = e.callee"))
def _(spark, sf):
    return C.lifelines(E(spark, sf), S(spark, sf))


@query("existence", with_ctes("symbols th_edges", f"SELECT sym_id FROM symbols WHERE {_CLASS} AND sym_id IN (SELECT to_sym FROM th_edges) AND sym_id NOT IN (SELECT parent_sym FROM symbols WHERE kind = 'METHOD' AND name = 'getInstance')"))
def _(spark, sf):
    """Classes that others build on, without a method of that name."""
    s = S(spark, sf)
    return Y.linked_without(s, H(spark, sf), s.filter("kind = 'METHOD' AND name = 'getInstance'"))


@query("uml_link_of_class", with_ctes("symbols th_edges", f"SELECT s.sym_id, coalesce(min(e.from_sym), -1) AS link FROM symbols s LEFT JOIN th_edges e ON e.to_sym = s.sym_id WHERE {_CLASS} GROUP BY s.sym_id"))
def _(spark, sf):
    return Y.first_link(S(spark, sf).filter(_CLASS), H(spark, sf).select(F.col("to_sym").alias("sym_id"), F.col("from_sym").alias("link")))


@query("field_to_class_fuzzy", with_ctes("symbols", f"""SELECT sym_id, arg_min(class_sym, (class_name, class_sym)) AS class_sym FROM (SELECT f.sym_id, c.sym_id AS class_sym, c.name AS class_name FROM (SELECT sym_id, f FROM (SELECT sym_id, lower(replace(name, '_', '')) AS f FROM symbols WHERE kind = 'FIELD') UNION SELECT sym_id, regexp_replace(lower(replace(name, '_', '')), 's$', '') FROM symbols WHERE kind = 'FIELD') f
  JOIN (SELECT sym_id, name, lower(replace(name, '_', '')) AS c FROM symbols WHERE {_CLASS}) c ON f.f = c.c OR (length(c.c) >= 4 AND ends_with(f.f, c.c)) OR (length(f.f) >= 4 AND ends_with(c.c, f.f))) GROUP BY sym_id"""))
def _(spark, sf):
    s = S(spark, sf)
    return Y.fuzzy_field_class(s.filter("kind = 'FIELD'"), s.filter(_CLASS))


@query("package_of_class", with_ctes("symbols files", f"""SELECT s.sym_id, coalesce(o.own, p.name, b.folder, 'default') AS package FROM symbols s LEFT JOIN (SELECT stem, min(folder) AS own FROM w GROUP BY stem) o ON o.stem = s.name LEFT JOIN symbols p ON p.sym_id = s.parent_sym AND p.kind = 'PACKAGE' LEFT JOIN (SELECT c.sym_id, min(folder) AS folder FROM symbols c JOIN w ON starts_with(w.stem, c.name) AND length(c.name) > 3 GROUP BY c.sym_id) b ON b.sym_id = s.sym_id WHERE s.{_CLASS}""").replace("\nSELECT", r""", w AS (SELECT regexp_extract(path, '([^/]+?)(\.[^./]*)?$', 1) AS stem, NULLIF(replace(regexp_extract(path, '^(?:.*/)?(?:java|kotlin|src)/(.*)/[^/]*$', 1), '/', '.'), '') AS folder FROM files WHERE regexp_extract(path, '^(?:.*/)?(?:java|kotlin|src)/(.*)/[^/]*$', 1) <> '')
SELECT""", 1))
def _(spark, sf):
    s = S(spark, sf)
    return Y.package_of_class(s.filter(_CLASS).select("sym_id", "name", "parent_sym"), projected(spark, sf, "files").select("path"), s)


# traceability: documents' lines as files, symbols' spans from order lines


@query("sym_span_index", "SELECT l_orderkey AS entity_id, min(l_partkey) AS first_tok, max(l_partkey) AS last_tok FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id")).agg(F.min("l_partkey").alias("first_tok"), F.max("l_partkey").alias("last_tok"))


@query("block_spans", with_ctes("blocks", "SELECT fn_sym, CAST(block AS BIGINT) AS block, CAST(first_ord AS BIGINT) AS first_tok, CAST(last_ord AS BIGINT) AS last_tok FROM blocks"))
def _(spark, sf):
    b = projected(spark, sf, "blocks").select("fn_sym", F.col("block").cast("long").alias("block"), "event_type")
    st = projected(spark, sf, "steps").select("fn_sym", "event_type", F.col("ord").cast("long").alias("first_tok"), F.col("ord").cast("long").alias("last_tok"))
    return R.block_spans(b, b.join(st, ["fn_sym", "event_type"]))


@query("forward_sym_query", "WITH r AS (SELECT l_suppkey % 10 AS file_id, l_orderkey AS entity_id, min(l_partkey) AS first_tok, max(l_partkey) AS last_tok FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1, 2) SELECT p.f AS file_id, p.t AS tok, entity_id, row_number() OVER (PARTITION BY p.f, p.t ORDER BY first_tok DESC, last_tok, entity_id) AS depth FROM (SELECT DISTINCT s_suppkey % 10 AS f, s_suppkey * 11 AS t FROM supplier) p JOIN r ON r.file_id = p.f AND first_tok <= p.t AND p.t <= last_tok")
def _(spark, sf):
    ranges = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_linestatus = 'F'").groupBy((F.col("l_suppkey") % 10).alias("file_id"), F.col("l_orderkey").alias("entity_id")).agg(F.min("l_partkey").alias("first_tok"), F.max("l_partkey").alias("last_tok"))
    points = table(spark, sf, "supplier").select((F.col("s_suppkey") % 10).alias("file_id"), (F.col("s_suppkey") * 11).alias("tok")).distinct()
    return R.covering(points, ranges)


@query("uml_links", with_ctes("tokens", "SELECT a.file_id, CAST(a.line AS BIGINT) AS line_start, CAST(a.col AS BIGINT) AS col_start, CAST(b.line AS BIGINT) AS line_end, CAST(b.col + b.len AS BIGINT) AS col_end FROM (SELECT file_id, max(ord) AS l FROM tokens GROUP BY file_id) m JOIN tokens a ON a.file_id = m.file_id AND a.ord = 0 JOIN tokens b ON b.file_id = m.file_id AND b.ord = m.l"))
def _(spark, sf):
    from graphloom.operators import tokens as T
    from graphloom.plans.q_tokens import lexed

    t = T.allocate_ids(lexed(spark, sf))
    syms = t.groupBy("file_id").agg(F.min("token_id").alias("first_tok"), F.max("token_id").alias("last_tok")).select(F.col("file_id").alias("sym_id"), F.lit("CLASS").alias("kind"), "first_tok", "last_tok")
    return R.uml_links(syms, t).select("file_id", *(F.col(c).cast("long").alias(c) for c in ("line_start", "col_start", "line_end", "col_end")))


@query("from_source", "SELECT doc_id AS file_id, x.line, 7000000 + doc_id AS sym_id FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), (VALUES (1), (3), (9)) x(line) WHERE x.line <= n".replace("x.line, 7000000", "CAST(x.line AS BIGINT) AS line, 7000000"))
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.size(F.split("text", "\n")).alias("n"))
    links = d.select("file_id", F.lit(1).alias("line_start"), F.col("n").alias("line_end"), (F.col("file_id") + 7000000).alias("sym_id"))
    lines = d.select("file_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 3, 9)])).alias("line"))
    return R.from_source(links, lines)


@query("filter_stale", "SELECT doc_id AS file_id, doc_id * 2 AS sym_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("h"))
    links = d.select("file_id", (F.col("file_id") * 2).alias("sym_id"), F.when(F.col("file_id") % 4 == 0, F.lit("old")).otherwise(F.col("h")).alias("link_hash"))
    current = d.filter("file_id % 5 <> 0").select("file_id", F.col("h").alias("hash"))
    return R.stale(links, current).select("file_id", "sym_id")


@query("compute_delta", "SELECT o_orderkey AS sym_id, CASE WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 7 = 1 THEN 'removed' ELSE 'moved' END AS change FROM orders WHERE o_orderkey % 7 IN (0, 1, 2)")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sym_id"), F.col("o_orderkey").alias("first_tok"), (F.col("o_orderkey") + 5).alias("last_tok"))
    after = o.filter("sym_id % 7 <> 1").withColumn("last_tok", F.col("last_tok") + F.when(F.col("sym_id") % 7 == 2, 1).otherwise(0))
    return R.delta(o.filter("sym_id % 7 <> 0"), after)


# UML records and patterns


@query("class_metrics", with_ctes("symbols", f"SELECT c.sym_id, count(*) FILTER (WHERE m.kind = 'FIELD') AS n_fields, count(*) FILTER (WHERE m.kind IN ('METHOD', 'CONSTRUCTOR')) AS n_methods, count(*) FILTER (WHERE m.{_CLASS}) AS n_inner FROM symbols c LEFT JOIN symbols m ON m.parent_sym = c.sym_id WHERE c.{_CLASS} GROUP BY c.sym_id"))
def _(spark, sf):
    return U.class_metrics(S(spark, sf))


@query("uml_classes", with_ctes("symbols th_edges", f"""SELECT c.sym_id, c.name, CASE c.kind WHEN 'INTERFACE' THEN 'interface' WHEN 'ENUM' THEN 'enum' WHEN 'RECORD' THEN 'record' ELSE CASE WHEN c.is_abstract THEN 'abstract' ELSE 'none' END END AS stereotype,
  (SELECT max(to_sym) FROM th_edges WHERE from_sym = c.sym_id AND relation = 'EXTENDS') AS extends_sym, (SELECT count(*) FROM th_edges WHERE from_sym = c.sym_id AND relation = 'IMPLEMENTS') AS n_implements,
  coalesce((SELECT string_agg(concat(CASE visibility WHEN 'public' THEN '+' WHEN 'private' THEN '-' WHEN 'protected' THEN '#' ELSE '~' END, name), ' ' ORDER BY ordinal, sym_id) FROM symbols WHERE parent_sym = c.sym_id AND kind = 'METHOD'), '') AS methods FROM symbols c WHERE c.{_CLASS}"""))
def _(spark, sf):
    return U.classes(S(spark, sf), H(spark, sf)).select("sym_id", "name", "stereotype", "extends_sym", "n_implements", F.array_join("methods", " ").alias("methods"))


@query("package_counts", with_ctes("symbols", f"SELECT p.sym_id, count(*) FILTER (WHERE m.{_CLASS}) AS n_classes, count(*) FILTER (WHERE m.kind = 'PACKAGE') AS n_packages FROM symbols p LEFT JOIN symbols m ON m.parent_sym = p.sym_id WHERE p.kind = 'PACKAGE' GROUP BY p.sym_id"))
def _(spark, sf):
    return U.packages(S(spark, sf))


@query("component_interfaces", with_ctes("symbols th_edges", "SELECT p.sym_id, (SELECT count(*) FROM symbols i WHERE i.parent_sym = p.sym_id AND i.kind = 'INTERFACE') AS n_provided, (SELECT count(*) FROM th_edges e JOIN symbols a ON a.sym_id = e.from_sym JOIN symbols b ON b.sym_id = e.to_sym AND b.kind = 'INTERFACE' WHERE a.parent_sym = p.sym_id AND b.parent_sym <> p.sym_id) AS n_required FROM symbols p WHERE p.kind = 'PACKAGE'"))
def _(spark, sf):
    return U.components(S(spark, sf), H(spark, sf))


@query("uml_state_machines", with_ctes("symbols", f"SELECT parent_sym AS class_sym, CAST(0 AS BIGINT) AS from_state, CAST(1 AS BIGINT) AS to_state, sym_id AS trigger FROM symbols WHERE kind = 'METHOD' AND parent_sym IN (SELECT sym_id FROM symbols WHERE {_CLASS})"))
def _(spark, sf):
    return U.state_machines(S(spark, sf))


@query("uml_objects", with_ctes("symbols", "SELECT l_orderkey AS fn_sym, CAST(l_linenumber AS BIGINT) AS ssa_id, 2000000 + l_suppkey AS type_sym FROM lineitem WHERE l_linenumber <> 2 AND 2000000 + l_suppkey IN (SELECT sym_id FROM symbols)"))
def _(spark, sf):
    defs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fn_sym"), F.col("l_linenumber").cast("long").alias("ssa_id"), (F.col("l_suppkey") + 2000000).alias("type_sym"), (F.col("l_linenumber") == 2).alias("is_phi"))
    return U.objects(defs, S(spark, sf))


@query("uml_sequences", with_ctes("symbols call_edges", "", True).rstrip() + """,
entries AS (SELECT sym_id FROM symbols WHERE kind = 'METHOD' AND visibility IN ('public', 'package') AND sym_id NOT IN (SELECT callee FROM call_edges)),
walk AS (SELECT sym_id AS entry, CAST([] AS BIGINT[]) AS path, [sym_id] AS open_, CAST(NULL AS BIGINT) AS caller, sym_id AS method FROM entries UNION ALL SELECT w.entry, list_append(w.path, e.site_id), list_append(w.open_, e.callee), e.caller, e.callee FROM walk w JOIN call_edges e ON e.caller = w.open_[-1] WHERE NOT list_contains(w.open_, e.callee) AND len(w.path) < 3)
SELECT entry, array_to_string(path, ' ') AS path, a.parent_sym AS from_class, b.parent_sym AS to_class, method FROM walk LEFT JOIN symbols a ON a.sym_id = caller JOIN symbols b ON b.sym_id = method""")
def _(spark, sf):
    s, e = S(spark, sf), E(spark, sf)
    found = U.sequences(C.entry_points(s, e), e, s, 3)
    return found.select("entry", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"), "from_class", "to_class", "method")


_PAT = {
    "pattern_singleton": (U.singleton, f"SELECT sym_id AS class_sym, 'singleton' AS pattern, CAST(100 AS BIGINT) AS confidence FROM symbols WHERE {_CLASS} AND sym_id IN (SELECT parent_sym FROM symbols WHERE kind IN ('FIELD', 'METHOD') AND (name IN ('instance', 'getInstance') OR (kind = 'FIELD' AND type_sym = parent_sym)))"),
    "pattern_observer": (U.observer, f"SELECT sym_id AS class_sym, 'observer' AS pattern, CAST(85 AS BIGINT) AS confidence FROM symbols WHERE {_CLASS} AND sym_id IN (SELECT parent_sym FROM symbols WHERE kind = 'METHOD' AND regexp_matches(lower(name), '^(add|register|attach).*listener'))"),
    "pattern_factory": (U.factory, f"SELECT sym_id AS class_sym, 'factory' AS pattern, CAST(90 AS BIGINT) AS confidence FROM symbols WHERE {_CLASS} AND contains(lower(name), 'factory')"),
    "pattern_builder": (U.builder, f"SELECT c.sym_id AS class_sym, 'builder' AS pattern, CAST(CASE WHEN c.name LIKE '%Builder' THEN 95 ELSE 75 END AS BIGINT) AS confidence FROM symbols c LEFT JOIN (SELECT parent_sym, avg(CASE WHEN type_sym = parent_sym THEN 1.0 ELSE 0.0 END) AS r FROM symbols WHERE kind = 'METHOD' GROUP BY parent_sym) m ON m.parent_sym = c.sym_id WHERE c.{_CLASS} AND (c.name LIKE '%Builder' OR r > 0.4)"),
    "pattern_state": (U.state, f"SELECT sym_id AS class_sym, 'state' AS pattern, CAST(85 AS BIGINT) AS confidence FROM symbols WHERE {_CLASS} AND regexp_matches(lower(name), 'state|strategy')"),
    "pattern_template_method": (U.template_method, "SELECT c.sym_id AS class_sym, 'template_method' AS pattern, CAST(80 AS BIGINT) AS confidence FROM symbols c JOIN (SELECT parent_sym FROM symbols WHERE kind = 'METHOD' GROUP BY parent_sym HAVING bool_or(is_abstract) AND bool_or(visibility = 'protected')) m ON m.parent_sym = c.sym_id WHERE c.kind = 'CLASS' AND c.is_abstract"),
}
for _name, (_f, _sql) in _PAT.items():
    query(_name, with_ctes("symbols", _sql))(lambda spark, sf, f=_f: f(S(spark, sf)))
_ALLPAT = " UNION ALL ".join(f"({sql})" for _, sql in _PAT.values())


@query("patterns_all", with_ctes("symbols", _ALLPAT))
def _(spark, sf):
    return U.patterns(S(spark, sf))


@query("pattern_labels", with_ctes("symbols", f"SELECT class_sym, arg_min(pattern, CASE pattern WHEN 'singleton' THEN 0 WHEN 'observer' THEN 1 WHEN 'factory' THEN 2 WHEN 'builder' THEN 3 WHEN 'state' THEN 4 ELSE 5 END) AS pattern FROM ({_ALLPAT}) GROUP BY class_sym"))
def _(spark, sf):
    return U.pattern_labels(S(spark, sf))


#: Suppliers own fields; every third is given a static method that returns it, so that strict patterns have something to find.
_GETTERS = "SELECT 20000000 + s_suppkey AS sym_id, 'instance' AS name, 'METHOD' AS kind, 2000000 + s_suppkey AS parent_sym, 'public' AS visibility, true AS is_static, false AS is_abstract, 2000000 + s_suppkey AS type_sym, s_suppkey AS ordinal FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT 30000000 + s_suppkey, 'only', 'FIELD', 2000000 + s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'private' ELSE 'public' END, true, false, 2000000 + s_suppkey, s_suppkey FROM supplier"


@query("pattern_strict_singleton", with_ctes("symbols", f"SELECT sym_id AS class_sym, 'strict_singleton' AS pattern, CAST(100 AS BIGINT) AS confidence FROM symbols WHERE {_CLASS} AND sym_id IN (SELECT parent_sym FROM (SELECT * FROM symbols UNION ALL {_GETTERS}) WHERE kind = 'FIELD' AND is_static AND visibility = 'private' AND type_sym = parent_sym) AND sym_id IN (SELECT parent_sym FROM (SELECT * FROM symbols UNION ALL {_GETTERS}) WHERE kind = 'METHOD' AND is_static AND visibility = 'public' AND type_sym = parent_sym)"))
def _(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    more = spark.sql(_GETTERS)
    spark.catalog.dropTempView("supplier")
    return U.strict_singleton(S(spark, sf).unionByName(more))


@query("pattern_strict_factory", with_ctes("symbols", "SELECT sym_id AS class_sym, 'strict_factory' AS pattern, CAST(100 AS BIGINT) AS confidence FROM symbols WHERE kind IN ('CLASS', 'INTERFACE') AND sym_id IN (SELECT m.parent_sym FROM symbols m JOIN symbols t ON t.sym_id = m.type_sym WHERE m.kind = 'METHOD' AND m.type_sym <> m.parent_sym AND (t.kind = 'INTERFACE' OR t.is_abstract))"))
def _(spark, sf):
    return U.strict_factory(S(spark, sf))


@query("pattern_strict_observer", with_ctes("symbols", "SELECT sym_id AS class_sym, 'strict_observer' AS pattern, CAST(100 AS BIGINT) AS confidence FROM symbols WHERE kind IN ('CLASS', 'INTERFACE') AND sym_id IN (SELECT parent_sym FROM symbols WHERE kind = 'METHOD' AND (name LIKE 'add%' OR name LIKE 'remove%') AND (contains(name, 'Listener') OR contains(name, 'Observer')))"))
def _(spark, sf):
    return U.strict_observer(S(spark, sf))


#: Every third class has no name of its own; its tokens are the words of the document of its number, at ten million times that number.
_NAMELESS = "SELECT c_custkey AS sym_id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name ELSE 'Unknown' END AS name, CASE WHEN c_custkey % 4 < 3 THEN c_custkey * 10000000 END AS first_tok FROM customer"


@query("resolve_name", with_ctes("tokens", f"""SELECT s.sym_id, CASE WHEN s.name NOT IN ('', 'Unknown') THEN s.name ELSE coalesce((SELECT arg_min(t.text, t.ord) FROM tokens t WHERE t.file_id * 10000000 = s.first_tok AND t.ord < 20 AND t.text NOT IN ({_sql_in(KEYWORDS)}, 'true', 'false', 'null', 'var', '@') AND regexp_matches(t.text, '^[\\p{{L}}_]')), CASE WHEN s.sym_id % 2 = 0 THEN concat('org.p', s.sym_id) END, 'Unknown') END AS name FROM ({_NAMELESS}) s"""))
def _(spark, sf):
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise("Unknown")
    syms = c.select(F.col("c_custkey").alias("sym_id"), name.alias("name"), F.when(F.col("c_custkey") % 4 < 3, F.col("c_custkey") * 10000000).alias("first_tok"))
    words = lexed(spark, sf).select((F.col("file_id") * 10000000 + F.col("ord")).alias("token_id"), "text", classify_token(F.col("text")).alias("token_type"))
    words = words.withColumn("token_type", F.when(F.col("token_type").isin("BooleanLiteral", "NullLiteral", "JavaVarKeyword", "JavaAnnotationMarker"), "Keyword").otherwise(F.col("token_type")))
    packages = syms.filter("sym_id % 2 = 0").select("sym_id", F.concat(F.lit("org.p"), "sym_id").alias("package"))
    return Y.resolve_names(syms, words, packages)


@query("cg_invariants", with_ctes("symbols call_sites", "SELECT 'site without a token' AS fault, count(*) AS n FROM call_sites WHERE site_id % 19 = 3 UNION ALL SELECT 'method not in one component', count(*) FROM symbols WHERE kind = 'METHOD' AND ordinal % 23 = 2"))
def _(spark, sf):
    """Some sites lose their token and some methods their component; those and no others are counted."""
    methods = S(spark, sf).filter("kind = 'METHOD'")
    found = L.scc(methods.select(F.col("sym_id").alias("node")), C.as_edges(E(spark, sf)))
    kept = found.join(methods.filter("ordinal % 23 <> 2").select(F.col("sym_id").alias("node")), "node", "left_semi")
    sites = projected(spark, sf, "call_sites").select("site_id", F.when(F.col("site_id") % 19 != 3, F.col("token")).alias("token"))
    return C.bad_calls(sites, methods, kept)


@query("span_sort", "SELECT l_orderkey AS file_id, l_linenumber AS entity_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_suppkey + CAST(l_quantity AS BIGINT) DESC, l_linenumber) - 1 AS ord FROM lineitem")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("entity_id"), F.col("l_suppkey").alias("first_tok"), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).alias("last_tok"))
    return R.sorted_spans(rows).select("file_id", "entity_id", "ord")


@query("sorted_result", with_ctes("call_edges", "SELECT caller AS sym, array_to_string(list(DISTINCT callee ORDER BY callee), ' ') AS neighbours FROM call_edges GROUP BY caller"))
def _(spark, sf):
    """Neighbours come in ascending order."""
    return C.adjacency(E(spark, sf)).select("sym", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"))


@query("fluent_ratio", with_ctes("symbols", "SELECT parent_sym AS sym_id, count(*) AS n_methods, count(*) FILTER (WHERE type_sym = parent_sym) AS n_fluent FROM symbols WHERE kind = 'METHOD' GROUP BY parent_sym"))
def _(spark, sf):
    return U.fluent_ratio(S(spark, sf))


_REL = "SELECT from_sym AS src, to_sym AS dst, relation, CASE relation WHEN 'EXTENDS' THEN 0 WHEN 'IMPLEMENTS' THEN 1 ELSE 2 END AS priority FROM th_edges"


@query("edge_dedup_priority", with_ctes("th_edges", f"SELECT src, dst, arg_min(relation, priority) AS relation FROM ({_REL}) GROUP BY src, dst"))
def _(spark, sf):
    e = H(spark, sf).select(F.col("from_sym").alias("src"), F.col("to_sym").alias("dst"), "relation", F.when(F.col("relation") == "EXTENDS", 0).when(F.col("relation") == "IMPLEMENTS", 1).otherwise(2).alias("priority"))
    return U.priority_edges(e)


@query("edge_optimizer", with_ctes("symbols th_edges", """SELECT DISTINCT src, relation, dst FROM (SELECT CASE WHEN e.relation = 'USES' AND p.name <> q.name THEN concat('pkg_', translate(p.name, '.-', '__')) ELSE a.name END AS src, CASE WHEN e.relation = 'USES' AND p.name <> q.name THEN '<<imports>>' ELSE e.relation END AS relation, CASE WHEN e.relation = 'USES' THEN concat('pkg_', translate(q.name, '.-', '__')) ELSE b.name END AS dst
  FROM th_edges e JOIN symbols a ON a.sym_id = e.from_sym JOIN symbols b ON b.sym_id = e.to_sym JOIN symbols p ON p.sym_id = a.parent_sym JOIN symbols q ON q.sym_id = b.parent_sym)"""))
def _(spark, sf):
    s = S(spark, sf)
    n = s.select("sym_id", "name", "parent_sym").join(s.select(F.col("sym_id").alias("parent_sym"), F.col("name").alias("pkg")), "parent_sym").select("sym_id", "name", "pkg")
    e = H(spark, sf).join(n.toDF("from_sym", "src", "src_package"), "from_sym").join(n.toDF("to_sym", "dst", "dst_package"), "to_sym")
    return U.optimized_edges(e)


@query("lca_scope_edges", with_ctes("files", "SELECT a.path AS src, b.path AS dst, CASE WHEN p[1:4] = q[1:4] THEN array_to_string(p[1:4], '.') WHEN p[1:3] = q[1:3] THEN array_to_string(p[1:3], '.') WHEN p[1:2] = q[1:2] THEN array_to_string(p[1:2], '.') WHEN p[1:1] = q[1:1] THEN p[1] ELSE '' END AS scope FROM (SELECT file_id, path, string_split(replace(path, '/', '.'), '.')[1:3] AS p FROM files) a JOIN (SELECT file_id, path, string_split(replace(path, '/', '.'), '.')[1:3] AS q FROM files) b ON b.file_id = a.file_id + 1"))
def _(spark, sf):
    f = projected(spark, sf, "files").select("file_id", "path", F.array_join(F.slice(F.split(F.translate("path", "/", "."), r"\."), 1, 3), ".").alias("pkg"))
    e = f.toDF("k", "src", "src_package").join(f.select((F.col("file_id") - 1).alias("k"), F.col("path").alias("dst"), F.col("pkg").alias("dst_package")), "k")
    return U.common_scope(e).select("src", "dst", "scope")


@query("package_edges", "WITH d AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier) WHERE c_nationkey <> s_nationkey) SELECT a.src AS a, a.dst AS b, CASE WHEN b.src IS NOT NULL THEN '<-.->' ELSE '-.->' END AS arrow FROM d a LEFT JOIN d b ON b.src = a.dst AND b.dst = a.src WHERE b.src IS NULL OR a.src < a.dst")
def _(spark, sf):
    n = table(spark, sf, "supplier").count()
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("dst"))
    return U.package_edges(table(spark, sf, "customer").select((F.col("c_custkey") % n).alias("k"), F.col("c_nationkey").alias("src")).join(s, "k"))


@query("precision_recall_f1", "WITH t AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), x AS (SELECT count(*) FILTER (WHERE t.k IS NOT NULL AND f.k IS NOT NULL) AS correct, count(*) FILTER (WHERE t.k IS NULL) AS phantom, count(*) FILTER (WHERE f.k IS NULL) AS missing FROM t FULL JOIN f ON t.k = f.k) SELECT correct, phantom, missing, round(correct / (correct + phantom), 9) AS precision, round(correct / (correct + missing), 9) AS recall FROM x")
def _(spark, sf):
    o = table(spark, sf, "orders")
    m = U.precision_recall(o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")))
    return m.select("correct", "phantom", "missing", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("gt_intersect_except", "SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'only', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def _(spark, sf):
    o = table(spark, sf, "orders")
    a, b = o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderstatus = 'O'").select("o_custkey")
    return a.intersect(b).agg(F.lit("both").alias("side"), F.count("*").alias("n")).unionByName(a.distinct().join(b, "o_custkey", "left_anti").agg(F.lit("only").alias("side"), F.count("*").alias("n")))


@query("diagram_counts", with_ctes("symbols th_edges call_edges", f"SELECT 'classes' AS name, count(*) AS n FROM symbols WHERE {_CLASS} UNION ALL SELECT 'packages', count(*) FROM symbols WHERE kind = 'PACKAGE' UNION ALL SELECT 'links', count(*) FROM th_edges UNION ALL SELECT 'messages', count(*) FROM call_edges"))
def _(spark, sf):
    from graphloom.operators.diagrams import counts

    s = S(spark, sf)
    return counts({"classes": s.filter(_CLASS), "packages": s.filter("kind = 'PACKAGE'"), "links": H(spark, sf), "messages": E(spark, sf)})


@query("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    from graphloom.streaming.incremental import event_windows

    return event_windows(table(spark, sf, "events"), "1 hour").select("start", "event_type", "n")


@query("incremental_upsert", "SELECT doc_id AS file_id, CASE WHEN doc_id % 10 = 3 THEN 'new' ELSE source END AS v FROM documents")
def _(spark, sf):
    from graphloom.streaming.incremental import upsert

    rows = table(spark, sf, "documents").select(F.lit("r").alias("repo_id"), F.col("doc_id").alias("file_id"), F.col("source").alias("v"))
    return upsert(rows, rows.filter("file_id % 10 = 3").withColumn("v", F.lit("new"))).select("file_id", "v")


@query("to_rebuild", "SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN 'Full' WHEN doc_id % 3 = 0 THEN 'Behavioral' ELSE 'Full' END AS scope FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(spark, sf):
    from graphloom.streaming.incremental import to_rebuild

    d = table(spark, sf, "documents").select(F.lit("r").alias("repo_id"), F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("hash"))
    known = d.filter("file_id % 2 = 1").withColumn("hash", F.when(F.col("file_id") % 3 == 0, "old").otherwise(F.col("hash")))
    return to_rebuild(d.withColumn("change", F.when(F.col("file_id") % 3 == 0, "body").otherwise("file")), known).select("file_id", "scope")
