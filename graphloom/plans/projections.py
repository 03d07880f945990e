"""The driver's tables read as program-graph tables, by SQL that Spark and DuckDB both run.

regions and nations are packages, customers and suppliers classes, orders methods,
parts fields; an order calls the customer's next one, an urgent order his first; a
user's event types are basic blocks, consecutive events edges and a last block the exit; conversations are
sequences; documents are files; tags of pages are syntax trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CTES = {
    "symbols": """
    SELECT CAST(r_regionkey AS BIGINT) AS sym_id, lower(r_name) AS name, 'PACKAGE' AS kind, CAST(NULL AS BIGINT) AS parent_sym, 'public' AS visibility, false AS is_static, false AS is_abstract, CAST(NULL AS BIGINT) AS type_sym, CAST(0 AS BIGINT) AS ordinal FROM region
    UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), lower(n_name), 'PACKAGE', CAST(n_regionkey AS BIGINT), 'public', false, false, NULL, CAST(n_nationkey AS BIGINT) FROM nation
    UNION ALL SELECT 1000000 + c_custkey,
      CASE c_custkey % 11 WHEN 0 THEN concat('Shape', c_custkey, 'Factory') WHEN 1 THEN concat('Order', c_custkey, 'Builder') WHEN 2 THEN concat('STATE_', c_custkey) WHEN 3 THEN concat('Light', c_custkey, 'State') WHEN 4 THEN concat('item', c_custkey) WHEN 5 THEN concat('Row', c_custkey, 'Binding') WHEN 6 THEN concat('Pay', c_custkey, 'Strategy') WHEN 7 THEN concat('Node', c_custkey, '_') WHEN 8 THEN concat('Du-', c_custkey) ELSE concat('Customer', c_custkey) END,
      CASE c_custkey % 10 WHEN 0 THEN 'INTERFACE' WHEN 1 THEN 'ENUM' WHEN 2 THEN 'RECORD' ELSE 'CLASS' END, CAST(100 + c_nationkey AS BIGINT), 'public', false, c_custkey % 7 = 0, NULL, c_custkey FROM customer
    UNION ALL SELECT 2000000 + s_suppkey, concat('Supplier', s_suppkey), 'CLASS', CAST(100 + s_nationkey AS BIGINT), 'public', false, s_suppkey % 3 = 0, NULL, s_suppkey FROM supplier
    UNION ALL SELECT 3000000 + p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'instance' WHEN 1 THEN concat('customer', p_partkey % 150) WHEN 2 THEN concat('suppliers', p_partkey % 10) ELSE concat('field', p_partkey) END, 'FIELD', CAST(2000000 + p_partkey % (SELECT count(*) FROM supplier) AS BIGINT), CASE p_size % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' ELSE 'public' END, p_size % 5 = 0, false, CAST(CASE WHEN p_partkey % 4 = 0 THEN 2000000 + p_partkey % (SELECT count(*) FROM supplier) WHEN p_partkey % 4 = 1 THEN NULL ELSE 1000000 + p_partkey % (SELECT count(*) FROM customer) END AS BIGINT), p_partkey FROM part
    UNION ALL SELECT 10000000 + o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'getInstance' WHEN 1 THEN 'addListener' WHEN 2 THEN 'registerClickListener' WHEN 3 THEN concat('with', o_orderkey % 7) ELSE concat('run', o_orderkey % 13) END, 'METHOD', 1000000 + o_custkey, CASE o_orderstatus WHEN 'F' THEN 'public' WHEN 'O' THEN 'package' ELSE 'protected' END, o_orderpriority = '1-URGENT', o_orderpriority = '5-LOW', CAST(CASE WHEN o_orderkey % 8 IN (1, 3) THEN 1000000 + o_custkey WHEN o_orderkey % 8 = 5 THEN 1000000 + o_orderkey % (SELECT count(*) FROM customer) END AS BIGINT), o_orderkey FROM orders""",
    "th_edges": """
    SELECT 1000000 + c_custkey AS from_sym, 1000000 + CAST(floor(c_custkey / 2) AS BIGINT) AS to_sym, 'EXTENDS' AS relation FROM customer WHERE c_custkey > 0
    UNION ALL SELECT 2000000 + s_suppkey, 1000000 + s_suppkey * 10, 'IMPLEMENTS' FROM supplier
    UNION ALL SELECT 2000000 + p_partkey % (SELECT count(*) FROM supplier), 1000000 + p_partkey % (SELECT count(*) FROM customer), 'USES' FROM part WHERE p_partkey % 4 > 1""",
    "call_sites": """
    SELECT o_orderkey * 2 AS site_id, 10000000 + o_orderkey AS caller, 10000000 + nxt AS callee, CASE o_orderstatus WHEN 'F' THEN 'VIRTUAL' WHEN 'O' THEN 'DIRECT' ELSE 'INTERFACE' END AS edge_type, o_orderkey % 4 AS n_children, o_orderkey * 10 AS token FROM (SELECT o_orderkey, o_orderstatus, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) x WHERE nxt IS NOT NULL
    UNION ALL SELECT o_orderkey * 2 + 1, 10000000 + o_orderkey, 10000000 + fst, 'SPECIAL', o_orderkey % 3, o_orderkey * 10 + 5 FROM (SELECT o_orderkey, o_orderpriority, min(o_orderkey) OVER (PARTITION BY o_custkey) AS fst FROM orders) y WHERE o_orderpriority = '1-URGENT'""",
    "call_edges": "SELECT caller, callee, min(site_id) AS site_id, min(edge_type) AS edge_type FROM call_sites GROUP BY caller, callee",
    "steps": """
    SELECT user_id AS fn_sym, event_type, event_id, ts, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM (
      SELECT user_id, event_type, event_id, ts FROM events WHERE user_id IS NOT NULL
      UNION ALL SELECT user_id, '~end', 1000000000000 + user_id, max(ts) FROM events WHERE user_id IS NOT NULL GROUP BY user_id) x""",
    "blocks": """
    SELECT fn_sym, event_type, rank() OVER (PARTITION BY fn_sym ORDER BY first_ord) - 1 AS block, first_ord, last_ord, n_stmts, last_ord = max(last_ord) OVER (PARTITION BY fn_sym) AS is_exit FROM (SELECT fn_sym, event_type, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n_stmts FROM steps GROUP BY fn_sym, event_type) b""",
    "cfg_edges": """
    SELECT DISTINCT s.fn_sym, a.block AS src, b.block AS dst FROM steps s JOIN blocks a ON a.fn_sym = s.fn_sym AND a.event_type = s.event_type JOIN blocks b ON b.fn_sym = s.fn_sym AND b.event_type = s.nxt WHERE s.nxt IS NOT NULL AND s.nxt <> s.event_type""",
    "files": """
    SELECT doc_id AS file_id, concat(source, '/', CASE doc_id % 6 WHEN 0 THEN 'src/main' WHEN 1 THEN 'src/test' WHEN 2 THEN 'build' WHEN 3 THEN '.git' WHEN 4 THEN 'tests' ELSE 'lib' END, '/', CASE doc_id % 5 WHEN 0 THEN 'Doc' WHEN 1 THEN 'DocTest' WHEN 2 THEN 'test_doc' ELSE 'Customer' END, doc_id % 150, '.', CASE doc_id % 9 WHEN 0 THEN 'java' WHEN 1 THEN 'KT' WHEN 2 THEN 'py' WHEN 3 THEN 'rs' WHEN 4 THEN 'txt' WHEN 5 THEN 'Java' WHEN 6 THEN 'h++' WHEN 7 THEN 'sql' ELSE 'cs' END) AS path, lang, text FROM documents""",
}
NEEDS = {"call_edges": ["call_sites"], "blocks": ["steps"], "cfg_edges": ["steps", "blocks"]}

#: DuckDB's side of what Spark does with functions of its own.
DUCK = {
    "tokens": r"""
    SELECT file_id, line, CAST(col AS INTEGER) AS col, row_number() OVER (PARTITION BY file_id ORDER BY line, k) - 1 AS ord, text, CAST(length(text) AS INTEGER) AS len
    FROM (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY file_id, line ORDER BY k) AS BIGINT) - length(text) AS col FROM (
      SELECT file_id, line, k, p[k] AS text FROM (SELECT file_id, line, regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[ \t\r\x0b\x0c]+|.') AS p FROM (
        SELECT file_id, i AS line, a[i] AS s FROM (SELECT doc_id AS file_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i))), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS k)))
    WHERE NOT regexp_full_match(text, '[ \t\r\x0b\x0c]+')""",
    "parens": r"""
    SELECT page_id AS file_id, i - 1 AS pos, tags[i][2:2] <> '/' AS is_open, regexp_extract(tags[i], '^</?([a-zA-Z0-9]+)', 1) AS name
    FROM (SELECT page_id, list_filter(regexp_extract_all(coalesce(html, ''), '</?[a-zA-Z][^>]*>'), lambda t: NOT regexp_matches(lower(t), '^</?(br|hr|img|input|link|meta|area|base|col|embed|source|track|wbr)\b') AND NOT regexp_matches(t, '/>$')) AS tags FROM pages), LATERAL (SELECT unnest(range(1, len(tags) + 1)) AS i)""",
    "leveled": """
    SELECT *, CASE WHEN is_open THEN excess ELSE excess + 1 END AS level, row_number() OVER (PARTITION BY file_id, is_open, CASE WHEN is_open THEN excess ELSE excess + 1 END ORDER BY pos) AS nth
    FROM (SELECT *, CAST(sum(CASE WHEN is_open THEN 1 ELSE -1 END) OVER (PARTITION BY file_id ORDER BY pos) AS BIGINT) AS excess, CAST(sum(CAST(is_open AS INT)) OVER (PARTITION BY file_id ORDER BY pos) AS BIGINT) AS rank1 FROM parens)""",
    "nodes": """
    SELECT o.file_id, o.rank1 - 1 AS pre, o.excess AS depth, CAST((c.pos - o.pos + 1) / 2 AS BIGINT) AS size, o.name, o.pos AS open_pos, c.pos AS close_pos
    FROM leveled o JOIN leveled c ON o.is_open AND NOT c.is_open AND o.file_id = c.file_id AND o.level = c.level AND o.nth = c.nth""",
    "tree": """
    SELECT a.file_id, a.pre, a.depth, a.size, a.name, (SELECT max(b.pre) FROM nodes b WHERE b.file_id = a.file_id AND b.depth = a.depth - 1 AND b.pre < a.pre) AS parent FROM nodes a""",
}
DUCK_NEEDS = {"leveled": ["parens"], "nodes": ["parens", "leveled"], "tree": ["parens", "leveled", "nodes"]}
_VOID = r"^</?(br|hr|img|input|link|meta|area|base|col|embed|source|track|wbr)\b"


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """DuckDB SQL over the named projections."""
    order: list[str] = []
    for n in names.split():
        order += [d for d in [*NEEDS.get(n, []), *DUCK_NEEDS.get(n, []), n] if d not in order]
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({CTES.get(n) or DUCK[n]})" for n in order) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projected(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame."""
    sql = ", ".join(f"{n} AS ({CTES[n]})" for n in [*NEEDS.get(name, []), name])
    args = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in sql or f"({t}" in sql}
    # every table by name, so that the text stays the one that the oracle runs
    for t, df in args.items():
        df.createOrReplaceTempView(t)
    out = spark.sql(f"WITH {sql} SELECT * FROM {name}")
    for t in args:
        spark.catalog.dropTempView(t)
    return out


def parens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, pos, is_open, name) from the tags of pages, without void elements."""
    tags = F.filter(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("(</?[a-zA-Z][^>]*>)"), 1), lambda t: ~F.lower(t).rlike(_VOID) & ~t.endswith("/>"))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.posexplode(tags).alias("pos", "tag"))
    return rows.select("file_id", F.col("pos").cast("long").alias("pos"), (F.substring("tag", 2, 1) != "/").alias("is_open"), F.regexp_extract("tag", "^</?([a-zA-Z0-9]+)", 1).alias("name"))
