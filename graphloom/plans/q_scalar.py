"""Queries over column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.plans.projections import projected, table, with_ctes
from graphloom.plans.q_tokens import _sql_in
from graphloom.plans.registry import query

_KINDS = ("identifier", "number", "float", "string", "true", "null", "comment", "block_comment", "+", "=>", ";", ":", "while", "x", "¿")


@query("classify_token_generic", f"""SELECT page_id, CASE k WHEN 'identifier' THEN 'Identifier' WHEN 'number' THEN 'IntegerLiteral' WHEN 'float' THEN 'FloatLiteral' WHEN 'string' THEN 'StringLiteral' WHEN 'true' THEN 'BooleanLiteral' WHEN 'null' THEN 'NullLiteral' WHEN 'comment' THEN 'CommentLine' WHEN 'block_comment' THEN 'CommentBlock' WHEN '+' THEN 'Operator' WHEN '=>' THEN 'Operator' WHEN ';' THEN 'Punctuation' WHEN ':' THEN 'Punctuation' WHEN 'while' THEN 'Keyword' ELSE 'Unknown' END AS token_type
  FROM (SELECT page_id, [{_sql_in(_KINDS)}][page_id % {len(_KINDS)} + 1] AS k FROM pages)""")
def _(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("page_id") % len(_KINDS) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", S.classify_generic(kind).alias("token_type"))


def _mapped(table_: dict[str, list[str]], col: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} IN ({_sql_in(ks)}) THEN '{k}'" for k, ks in table_.items()) + f" ELSE {otherwise} END"


@query("classify_token_kotlin", with_ctes("tokens", f"SELECT {_mapped(S.KOTLIN_KINDS, 'text', chr(39) + 'Unknown' + chr(39))} AS token_type, count(*) AS n FROM tokens GROUP BY 1"))
def _(spark, sf):
    from graphloom.plans.q_tokens import lexed

    return lexed(spark, sf).groupBy(S.classify_kotlin(F.col("text")).alias("token_type")).agg(F.count("*").alias("n"))


_GENERIC = ("class_definition", "function_item", "let_declaration", "if_statement", "while_statement", "call_expression", "await_expression", "macro_definition", "string", "this", "goto_statement", "heredoc_body", "block", "trait_item")


@query("reduce_generic", f"SELECT page_id, CASE k WHEN 'class_definition' THEN 'CLASS_DECL' WHEN 'function_item' THEN 'METHOD_DECL' WHEN 'let_declaration' THEN 'LOCAL_VAR_DECL' WHEN 'if_statement' THEN 'IF_STMT' WHEN 'while_statement' THEN 'WHILE_STMT' WHEN 'call_expression' THEN 'CALL_EXPR' WHEN 'await_expression' THEN 'EXPR_STMT' WHEN 'macro_definition' THEN 'LOCAL_VAR_DECL' WHEN 'string' THEN 'LITERAL' WHEN 'this' THEN 'THIS_EXPR' WHEN 'goto_statement' THEN 'EXPR_STMT' WHEN 'block' THEN 'BLOCK' WHEN 'trait_item' THEN 'INTERFACE_DECL' END AS node_type FROM (SELECT page_id, [{_sql_in(_GENERIC)}][page_id % {len(_GENERIC)} + 1] AS k FROM pages)")
def _(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _GENERIC]), (F.col("page_id") % len(_GENERIC) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", S.reduce_generic(kind).alias("node_type"))


_MODS = "CASE o_orderkey % 6 WHEN 0 THEN 'public static' WHEN 1 THEN 'private final' WHEN 2 THEN 'protected abstract' WHEN 3 THEN 'public private' WHEN 4 THEN 'static final abstract' ELSE '' END"
_OPS = "CASE o_orderkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '&&' WHEN 3 THEN '!=' ELSE '%' END"


@query("encode_attrs", f"""SELECT o_orderkey, (vis << 28) | (mods << 20) | (op << 12) AS attr FROM (SELECT o_orderkey, CASE WHEN contains(m, 'public') THEN 1 WHEN contains(m, 'private') THEN 2 WHEN contains(m, 'protected') THEN 3 ELSE 0 END::BIGINT AS vis,
  (CASE WHEN contains(m, 'static') THEN 1 ELSE 0 END + CASE WHEN contains(m, 'final') THEN 2 ELSE 0 END + CASE WHEN contains(m, 'abstract') THEN 4 ELSE 0 END)::BIGINT AS mods, CASE p WHEN '=' THEN 1 WHEN '+' THEN 16 WHEN '&&' THEN 27 WHEN '!=' THEN 22 ELSE 0 END::BIGINT AS op FROM (SELECT o_orderkey, {_MODS} AS m, {_OPS} AS p FROM orders))""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.encode_attrs(F.expr(_MODS), F.expr(_OPS)).alias("attr"))


@query("pack_attr", "SELECT l_orderkey, l_linenumber, ((l_orderkey & 15) << 28) | ((l_partkey & 255) << 20) | ((l_suppkey & 255) << 12) | ((CAST(l_linenumber AS BIGINT) & 15) << 8) | (CAST(l_quantity AS BIGINT) & 255) AS attr FROM lineitem")
def _(spark, sf):
    attr = S.pack_attr(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", attr.alias("attr"))


@query("unpack_attr", "SELECT l_orderkey, l_linenumber, l_orderkey & 15 AS visibility, l_partkey & 255 AS modifiers, l_suppkey & 255 AS operator FROM lineitem")
def _(spark, sf):
    k = S.unpack_attr(S.pack_attr(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(k[x].alias(x) for x in ("visibility", "modifiers", "operator")))


_NODES = "CASE c_custkey % 8 WHEN 0 THEN 'CLASS_DECL' WHEN 1 THEN 'METHOD_DECL' WHEN 2 THEN 'FIELD_DECL' WHEN 3 THEN 'BLOCK' WHEN 4 THEN 'LAMBDA_EXPR' WHEN 5 THEN 'IF_STMT' WHEN 6 THEN 'ENUM_DECL' ELSE 'MODULE' END"


@query("symbol_kind", f"SELECT c_custkey, CASE t WHEN 'CLASS_DECL' THEN 'CLASS' WHEN 'METHOD_DECL' THEN 'METHOD' WHEN 'FIELD_DECL' THEN 'FIELD' WHEN 'LAMBDA_EXPR' THEN 'LAMBDA' WHEN 'ENUM_DECL' THEN 'ENUM' WHEN 'MODULE' THEN 'MODULE' END AS kind, t NOT IN ('BLOCK', 'IF_STMT') AS is_declaration FROM (SELECT c_custkey, {_NODES} AS t FROM customer)")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.symbol_kind(F.expr(_NODES)).alias("kind"), S.is_declaration(F.expr(_NODES)).alias("is_declaration"))


@query("scope_kind", f"SELECT c_custkey, CASE t WHEN 'CLASS_DECL' THEN 'CLASS' WHEN 'ENUM_DECL' THEN 'CLASS' WHEN 'METHOD_DECL' THEN 'METHOD' WHEN 'LAMBDA_EXPR' THEN 'METHOD' WHEN 'BLOCK' THEN 'BLOCK' WHEN 'MODULE' THEN 'FILE' END AS kind FROM (SELECT c_custkey, {_NODES} AS t FROM customer)")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.scope_kind(F.expr(_NODES)).alias("kind"))


_TYPES = "CASE p_partkey % 7 WHEN 0 THEN 'int' WHEN 1 THEN 'List' WHEN 2 THEN 'java.util.Map' WHEN 3 THEN 'String' WHEN 4 THEN 'void' WHEN 5 THEN 'Iterable' ELSE p_brand END"


@query("primitive_type", f"SELECT p_partkey, t IN ({_sql_in(S.PRIMITIVES)}) AS is_primitive, t IN ({_sql_in(S.COLLECTIONS)}) AS is_collection FROM (SELECT p_partkey, {_TYPES} AS t FROM part)")
def _(spark, sf):
    t = F.expr(_TYPES)
    return table(spark, sf, "part").select("p_partkey", t.isin(S.PRIMITIVES).alias("is_primitive"), t.isin(S.COLLECTIONS).alias("is_collection"))


@query("default_visibility", with_ctes("symbols", "SELECT sym_id, CASE WHEN kind IN ('CLASS', 'INTERFACE', 'ENUM', 'RECORD') THEN 'package' ELSE 'public' END AS visibility FROM symbols"))
def _(spark, sf):
    return projected(spark, sf, "symbols").select("sym_id", S.default_visibility(F.col("kind")).alias("visibility"))


@query("stereotype", with_ctes("symbols", "SELECT sym_id, CASE kind WHEN 'INTERFACE' THEN 'interface' WHEN 'ENUM' THEN 'enum' WHEN 'RECORD' THEN 'record' ELSE CASE WHEN is_abstract THEN 'abstract' ELSE 'none' END END AS stereotype FROM symbols"))
def _(spark, sf):
    mods = F.when(F.col("is_abstract"), F.array(F.lit("abstract"))).otherwise(F.array().cast("array<string>"))
    return projected(spark, sf, "symbols").select("sym_id", S.stereotype(F.col("kind"), mods).alias("stereotype"))


@query("call_type", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'CONSTRUCTOR' WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 'DYNAMIC' WHEN l_linenumber = 1 THEN 'SPECIAL' WHEN l_partkey % 5 = 0 THEN 'DIRECT' WHEN l_partkey % 5 = 1 THEN 'SPECIAL' WHEN l_suppkey % 3 = 0 THEN 'INTERFACE' ELSE 'VIRTUAL' END AS call_type FROM lineitem""")
def _(spark, sf):
    node = F.when(F.col("l_returnflag") == "A", "NEW_EXPR").when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 2), "METHOD_REF").otherwise("CALL_EXPR")
    mods = F.when(F.col("l_partkey") % 5 == 0, F.array(F.lit("static"))).otherwise(F.array().cast("array<string>"))
    kind = S.call_type(node, F.col("l_linenumber") - 1, mods, F.when(F.col("l_partkey") % 5 == 1, "private").otherwise("public"), F.when(F.col("l_suppkey") % 3 == 0, "INTERFACE").otherwise("CLASS"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("call_type"))


@query("classify_delta", "SELECT event_id, CASE event_type WHEN 'view' THEN 'None' WHEN 'click' THEN 'Behavioral' WHEN 'purchase' THEN 'Structural' ELSE 'Full' END AS scope FROM events")
def _(spark, sf):
    change = F.when(F.col("event_type") == "view", "trivia").when(F.col("event_type") == "click", "body").when(F.col("event_type") == "purchase", "type").otherwise("file")
    return table(spark, sf, "events").select("event_id", S.rebuild_scope(change).alias("scope"))


@query("sanitize", "SELECT c_custkey, CASE WHEN c IN ('', 'Unknown', 'void') THEN 'SystemNode' WHEN regexp_matches(c, '^[0-9]') THEN concat('Node_', c) ELSE c END AS safe FROM (SELECT c_custkey, regexp_replace(CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN '' WHEN 2 THEN concat(c_custkey, ' x.y') WHEN 3 THEN 'void' ELSE c_mktsegment END, '[^\\p{L}\\p{N}_]', '_', 'g') AS c FROM customer)")
def _(spark, sf):
    raw = F.expr("CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN '' WHEN 2 THEN concat(c_custkey, ' x.y') WHEN 3 THEN 'void' ELSE c_mktsegment END")
    return table(spark, sf, "customer").select("c_custkey", S.sanitize(raw).alias("safe"))


@query("is_primitive_or_system", with_ctes("symbols", f"SELECT sym_id, name IN ({_sql_in(S.SYSTEM_NAMES)}) AS is_system FROM symbols"))
def _(spark, sf):
    return projected(spark, sf, "symbols").select("sym_id", S.is_system_name(F.col("name")).alias("is_system"))


@query("visibility_glyph", with_ctes("symbols", "SELECT sym_id, CASE visibility WHEN 'public' THEN '+' WHEN 'private' THEN '-' WHEN 'protected' THEN '#' ELSE '~' END AS glyph FROM symbols"))
def _(spark, sf):
    return projected(spark, sf, "symbols").select("sym_id", S.visibility_glyph(F.col("visibility")).alias("glyph"))


@query("label_truncation", "SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 37), '...') ELSE text END AS label FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.truncated(F.col("text")).alias("label"))


@query("pkg_alias", with_ctes("symbols", "SELECT sym_id, concat('pkg_', translate(name, '.-', '__')) AS alias FROM symbols WHERE kind = 'PACKAGE'"))
def _(spark, sf):
    return projected(spark, sf, "symbols").filter("kind = 'PACKAGE'").select("sym_id", S.package_alias(F.col("name")).alias("alias"))


@query("span_text", "SELECT l_orderkey, l_linenumber, format('L{}:C{} - L{}:C{}', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS span FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.span_text(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("span"))


@query("sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("composite_hash")
def _(spark, sf):
    o = [F.col("o_orderkey"), F.col("o_custkey"), F.xxhash64("o_orderstatus"), F.xxhash64("o_orderpriority"), F.lit(7).cast("long"), F.col("o_orderkey") * 31]
    return table(spark, sf, "orders").select("o_orderkey", S.composite_hash(*o).alias("hash"))


@query("folded_hash", "SELECT l_orderkey, l_linenumber, (x & 4294967295) # 0 AS hash FROM (SELECT l_orderkey, l_linenumber, xor(xor(l_orderkey, l_partkey << 33), l_suppkey) AS x FROM lineitem)".replace("(x & 4294967295) # 0", "xor(x & 4294967295, x >> 32)"))
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.folded_hash(F.col("l_orderkey"), F.shiftleft("l_partkey", 33), F.col("l_suppkey")).alias("hash"))


@query("fnv1a")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.fnv1a(F.col("p_name")).alias("hash"))


@query("crc64")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.crc64(F.col("p_name")).alias("hash"))


@query("json_escape", "SELECT page_id, CAST(json_object('url', url) AS VARCHAR) AS json FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.to_json(F.struct("url")).alias("json"))
