"""Queries over Java sources written from the driver's tables: every supplier is a class in its nation's package, built on the supplier of half its number and holding the next one; every part is a method of its supplier. What the sources mean follows from the tables, so SQL can say it without a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import ProgramGraph
from graphloom.operators import callgraph, diagrams, flow, java, symbols, trace
from graphloom.plans.projections import table
from graphloom.plans.registry import query

_MADE: dict[tuple[str, str], ProgramGraph] = {}


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, path, text)"""
    n, n_parts = table(spark, sf, "supplier").count(), table(spark, sf, "part").count()
    k, s = F.floor(F.col("p_partkey") / n), F.col("p_partkey") % n
    nxt = F.when(F.col("p_partkey") + n < n_parts, k + 1).otherwise(k)
    body = (
        F.when(F.col("p_partkey") % 4 == 0, F.format_string("  public int m%d(int n) { if (n > %d) { return m%d(n - 1); } else { n = n + 1; } return n; }\n", k, "p_size", nxt))
        .when(F.col("p_partkey") % 4 == 1, F.format_string("  int m%d(int n) { while (n > 0) { n--; } peer.m%d(n); return total; }\n", k, k))
        .when(F.col("p_partkey") % 4 == 2, F.format_string("  static int m%d(int n) { for (int i = 0; i < n; i++) { total += i; } return total; }\n", k))
        .otherwise(F.format_string("  protected void m%d(int n) { S%d own = new S%d(); own.m%d(n); }\n", k, s, s, nxt))
    )
    methods = table(spark, sf, "part").select(s.alias("s"), F.struct(k.alias("k"), body.alias("text")).alias("m")).groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("m"))["text"], "").alias("methods"))
    at = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"), "s_nationkey")
    up, peer = F.floor(F.col("s") / 2), (F.col("s") + 1) % n
    rows = at.join(methods.hint("merge"), "s", "left").join(at.select(F.col("s").alias("_u"), F.col("s_nationkey").alias("un")), F.col("_u") == up).join(at.select(F.col("s").alias("_p"), F.col("s_nationkey").alias("pn")), F.col("_p") == peer)
    head = F.concat(F.format_string("package org.n%d;\nimport org.n%d.S%d;\nimport org.n%d.S%d;\npublic class S%d ", "s_nationkey", "un", "_u", "pn", "_p", "s"), F.when(F.col("s") > 0, F.format_string("extends S%d ", "_u")).otherwise(""))
    text = F.concat(head, F.format_string("{\n  private S%d peer;\n  private static int total;\n", "_p"), F.coalesce("methods", F.lit("")), F.lit("}\n"))
    return rows.select(F.col("s").alias("file_id"), F.format_string("org/n%d/S%d.java", "s_nationkey", "s").alias("path"), text.alias("text"))


def graph(spark: SparkSession, sf: str) -> ProgramGraph:
    """Its tables are written where they are made; one graph for an application and a folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MADE:
        _MADE[key] = ProgramGraph(sources(spark, sf))
    return _MADE[key]


#: What the sources say: classes c, methods p with the number and kind of each, and which class lies below which.
_TOLD = """WITH RECURSIVE n AS (SELECT (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM part) AS p),
c AS (SELECT s_suppkey AS s, s_nationkey AS nation FROM supplier),
p AS (SELECT p_partkey AS p, p_partkey % n.s AS s, p_partkey // n.s AS k, p_partkey % 4 AS kind, CASE WHEN p_partkey + n.s < n.p THEN p_partkey // n.s + 1 ELSE p_partkey // n.s END AS nxt FROM part, n),
below AS (SELECT s AS top, s FROM c UNION ALL SELECT b.top, c.s FROM below b JOIN c ON c.s // 2 = b.s AND c.s > 0),
asks AS (SELECT p.p, p.s, p.k, p.kind, CASE WHEN kind = 1 THEN (p.s + 1) % n.s ELSE p.s END AS rs, CASE WHEN kind = 1 THEN p.k ELSE p.nxt END AS rk FROM p, n WHERE kind <> 2),
calls AS (SELECT a.*, t.kind = 2 AS direct FROM asks a JOIN p t ON t.s = a.rs AND t.k = a.rk),
edges AS (SELECT s, k, rs AS cs, rk AS ck FROM calls WHERE direct OR kind = 3 UNION SELECT x.s, x.k, b.s, x.rk FROM calls x JOIN below b ON b.top = x.rs WHERE NOT direct AND kind <> 3)
"""


def _named(g: ProgramGraph) -> DataFrame:
    """(sym_id, label): a class's name, a member's behind its class's."""
    own = g.symbols.select("sym_id", "name", "parent_sym")
    above = own.select(F.col("sym_id").alias("parent_sym"), F.col("name").alias("_up"))
    return own.join(above, "parent_sym", "left").select("sym_id", F.concat_ws(".", "_up", "name").alias("label"))


@query("java_classes", _TOLD + "SELECT concat('S', s) AS name, concat('org.n', nation) AS package FROM c")
def _(spark, sf):
    g = graph(spark, sf)
    classes = symbols.class_candidates(g.symbols).select("file_id", "name")
    return classes.join(java.packages(g.ast), "file_id").select("name", "package")


@query("java_symbols", _TOLD + """SELECT concat('S', s, '.m', k) AS label, 'METHOD' AS kind, CASE kind WHEN 3 THEN 'protected' ELSE 'public' END AS visibility, kind = 2 AS is_static FROM p
UNION ALL SELECT concat('S', s, '.peer'), 'FIELD', 'private', false FROM c UNION ALL SELECT concat('S', s, '.total'), 'FIELD', 'private', true FROM c""")
def _(spark, sf):
    g = graph(spark, sf)
    return g.symbols.filter("kind IN ('METHOD', 'FIELD')").join(_named(g), "sym_id").select("label", "kind", "visibility", "is_static")


@query("java_hierarchy", _TOLD + "SELECT concat('S', s) AS sub, concat('S', s // 2) AS super, 'EXTENDS' AS relation FROM c WHERE s > 0")
def _(spark, sf):
    g = graph(spark, sf)
    names = _named(g)
    return g.th_edges.join(names.toDF("from_sym", "sub"), "from_sym").join(names.toDF("to_sym", "super"), "to_sym").select("sub", "super", "relation")


@query("java_associations", _TOLD + "SELECT concat('S', c.s) AS owner, concat('S', (c.s + 1) % n.s) AS held, 'peer' AS role FROM c, n")
def _(spark, sf):
    g = graph(spark, sf)
    names = _named(g)
    return g.associations.join(names.toDF("from_sym", "owner"), "from_sym").join(names.toDF("to_sym", "held"), "to_sym").select("owner", "held", "role")


@query("java_call_sites", _TOLD + "SELECT concat('S', s, '.m', k) AS caller, concat('S', rs, '.m', rk) AS target, CASE WHEN direct THEN 'DIRECT' ELSE 'VIRTUAL' END AS call_type FROM calls")
def _(spark, sf):
    g = graph(spark, sf)
    names = _named(g)
    calls = g.call_sites.filter("node_type = 'CALL_EXPR'")
    return calls.join(names.toDF("_c", "caller_name"), F.col("caller") == F.col("_c")).join(names.toDF("target", "target_name"), "target").select(F.col("caller_name").alias("caller"), F.col("target_name").alias("target"), "call_type")


@query("resolve_target", _TOLD + "SELECT concat('S', s, '.m', k) AS caller, concat('S', cs, '.m', ck) AS callee FROM edges")
def _(spark, sf):
    g = graph(spark, sf)
    names = _named(g)
    return g.call_edges.join(names.toDF("_a", "a"), F.col("caller") == F.col("_a")).join(names.toDF("_b", "b"), F.col("callee") == F.col("_b")).select(F.col("a").alias("caller"), F.col("b").alias("callee"))


@query("build_cfg", _TOLD + "SELECT concat('S', s, '.m', k) AS method, CASE kind WHEN 3 THEN 1 ELSE 2 END AS cyclomatic, CAST(kind IN (1, 2) AS INT) AS loops FROM p")
def _(spark, sf):
    g = graph(spark, sf)
    n = g.table("loops").groupBy("fn_sym").agg(F.countDistinct("header").cast("int").alias("loops"))
    found = flow.cyclomatic(g.blocks, g.cfg_edges).join(n, "fn_sym", "left").fillna(0, ["loops"])
    return found.join(_named(g).toDF("fn_sym", "method"), "fn_sym").select("method", "cyclomatic", "loops")


@query("java_def_use", _TOLD + "SELECT concat('S', s, '.m', k) AS method, v AS var FROM p, (VALUES ('n'), ('i'), ('own'), ('total')) x(v) WHERE v = 'n' OR (v IN ('i', 'total') AND kind = 2) OR (v = 'own' AND kind = 3)")
def _(spark, sf):
    """Variables that a method sets somewhere."""
    g = graph(spark, sf)
    return g.table("ssa_defs").join(_named(g).toDF("fn_sym", "method"), "fn_sym").select("method", "var").distinct()


@query("java_entry_points", _TOLD + "SELECT concat('S', p.s, '.m', p.k) AS method FROM p WHERE kind <> 3 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.cs = p.s AND e.ck = p.k)")
def _(spark, sf):
    g = graph(spark, sf)
    return callgraph.entry_points(g.symbols, g.call_edges).join(_named(g), "sym_id").select(F.col("label").alias("method"))


@query("java_tokens", _TOLD + "SELECT concat('S', s) AS class, CAST(count(*) AS BIGINT) AS methods, CAST(count(*) FILTER (WHERE kind = 1) AS BIGINT) AS whiles FROM p GROUP BY s")
def _(spark, sf):
    """Braces that open a method and words `while`, by class, from the token stream."""
    g = graph(spark, sf)
    words = g.tokens.groupBy("file_id").agg(F.sum(F.col("text").rlike("^m[0-9]+$").cast("int")).alias("m"), F.sum((F.col("text") == "while").cast("int")).alias("whiles"))
    calls = g.call_sites.filter("node_type = 'CALL_EXPR'").groupBy("file_id").agg(F.count("*").alias("calls"))
    classes = g.symbols.filter("kind = 'CLASS'").select("file_id", F.col("name").alias("class"))
    return words.join(calls, "file_id", "left").join(classes, "file_id").select("class", (F.col("m") - F.coalesce("calls", F.lit(0))).alias("methods"), "whiles")


@query("cs_span_index", _TOLD + "SELECT concat('S', s, '.m', k) AS caller, CAST(6 + k AS BIGINT) + 1 AS line FROM calls")
def _(spark, sf):
    """The line of every call."""
    g = graph(spark, sf)
    at = g.spans.filter("layer = 'cs'").select(F.col("entity_id").alias("site_id"), F.col("line_start").cast("long").alias("line"))
    calls = g.sites.filter("node_type = 'CALL_EXPR'").select("site_id", "caller").join(at, "site_id")
    return calls.join(_named(g).toDF("_c", "label"), F.col("caller") == F.col("_c")).select(F.col("label").alias("caller"), "line")


@query("forward_cs_query", _TOLD + "SELECT concat('S', s, '.m', k) AS caller, CAST(1 AS BIGINT) AS n FROM calls")
def _(spark, sf):
    """How many calls a token in the middle of each call is in."""
    g = graph(spark, sf)
    spans = g.spans.filter("layer = 'cs'").select("file_id", "entity_id", "first_tok", "last_tok").join(g.call_sites.filter("node_type = 'CALL_EXPR'").select(F.col("site_id").alias("entity_id"), "caller"), "entity_id")
    points = spans.select("file_id", F.floor((F.col("first_tok") + F.col("last_tok")) / 2).alias("tok"), "caller").distinct()
    hit = trace.covering(points.select("file_id", "tok"), spans.select("file_id", "entity_id", "first_tok", "last_tok"))
    found = points.join(hit.groupBy("file_id", "tok").agg(F.count("*").alias("n")), ["file_id", "tok"])
    return found.join(_named(g).toDF("_c", "label"), F.col("caller") == F.col("_c")).select(F.col("label").alias("caller"), "n")


@query("tra_invariants", "SELECT s_suppkey AS file_id, CAST(1 AS BIGINT) AS n FROM supplier WHERE s_suppkey % 3 = 2")
def _(spark, sf):
    """In every third file the class's span is turned round; those and no others are reported."""
    g = graph(spark, sf)
    spans = g.extents.filter("layer = 'sym'").join(g.declared.filter("kind = 'CLASS'").select(F.col("sym_id").alias("entity_id")), "entity_id", "left_semi")
    turned = F.col("file_id") % 3 == 2
    bad = spans.select("file_id", "entity_id", F.when(turned, F.col("last_tok")).otherwise(F.col("first_tok")).alias("first_tok"), F.when(turned, F.col("first_tok")).otherwise(F.col("last_tok")).alias("last_tok"))
    every = bad.unionByName(g.extents.filter("layer <> 'sym'").select("file_id", "entity_id", "first_tok", "last_tok"))
    return trace.bad_spans(every).groupBy("file_id").agg(F.count("*").alias("n"))


def _table(name: str):
    def run(spark, sf):
        df = graph(spark, sf).table(name)
        return df.select(*[F.to_json(F.struct(c)).alias(c) if t.startswith(("array", "struct")) else F.col(c) for c, t in df.dtypes])

    return run


for _name, _of in {"parse_cst": "ast", "java_cfg_edges": "cfg_edges", "java_dominators": "dom", "java_loops": "loops", "java_cdg": "cdg", "java_ssa": "ssa_defs", "java_phis": "phis", "java_scc": "scc", "build_function": "path_metrics", "java_patterns": "patterns"}.items():
    query(_name)(_table(_of))


@query("reduce_java", _TOLD + "SELECT 'METHOD_DECL' AS node_type, count(*) AS n FROM p UNION ALL SELECT 'CLASS_DECL', count(*) FROM c UNION ALL SELECT 'FIELD_DECL', 2 * count(*) FROM c UNION ALL SELECT 'IMPORT_DECL', 2 * count(*) FROM c UNION ALL SELECT 'WHILE_STMT', count(*) FROM p WHERE kind = 1 UNION ALL SELECT 'IF_STMT', count(*) FROM p WHERE kind = 0")
def _(spark, sf):
    kinds = ["METHOD_DECL", "CLASS_DECL", "FIELD_DECL", "IMPORT_DECL", "WHILE_STMT", "IF_STMT"]
    return graph(spark, sf).ast.filter(F.col("node_type").isin(kinds)).groupBy("node_type").agg(F.count("*").alias("n"))


def _diagram(kind: str, style: str):
    def run(spark, sf):
        return graph(spark, sf).diagram_row(kind, style).select(F.lit(kind).alias("kind"), "diagram")

    return run


for _kind in diagrams.KINDS:
    for _style in ("plantuml", "mermaid"):
        query(f"{_style}_{_kind}")(_diagram(_kind, _style))


@query("json_classes")
def _(spark, sf):
    return diagrams.json_classes(graph(spark, sf).classes)


@query("xmi_classes")
def _(spark, sf):
    return diagrams.xmi_classes(graph(spark, sf).classes)
