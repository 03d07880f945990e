"""Queries over files and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import tokens as T
from graphloom.plans.projections import projected, table, with_ctes
from graphloom.plans.registry import query
from graphloom.sources import files as FS


def _sql_in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _lang_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} IN ({_sql_in(es)}) THEN '{k}'" for k, es in S.LANGUAGES.items()) + " ELSE 'Unknown' END"


_EXT = r"regexp_extract(path, '[^/.][^/]*\.([^./]*)$', 1)"
_STEM = r"regexp_extract(path, '([^/]+?)(\.[^./]*)?$', 1)"
OPENERS, BLOCKED = ("the", "la", "der", "el"), ("of", "and", "de")


def lexed(spark, sf):
    return T.lex(table(spark, sf, "documents"), "doc_id")


@query("scan_tree_cli", with_ctes("files", f"SELECT file_id, path FROM files WHERE lower({_EXT}) IN ('java', 'kt', 'kts')"))
def _(spark, sf):
    return projected(spark, sf, "files").filter(S.is_cli_source(F.col("path"))).select("file_id", "path")


_ALL = [e for es in S.LANGUAGES.values() for e in es] + S.OTHER_SOURCES


@query("scan_tree_server", with_ctes("files", rf"""SELECT file_id, path FROM files WHERE lower({_EXT}) IN ({_sql_in(_ALL)})
  AND NOT regexp_matches(lower(path), '(^|/)({"|".join(d.replace(".", chr(92) + ".") for d in S.SKIPPED_DIRS)})/') AND NOT regexp_matches(path, '(^|/)\.[^/]*') AND NOT regexp_matches(lower(path), '(^|/)({"|".join(d[1:] for d in S.TEST_DIRS)})/')
  AND NOT regexp_matches(lower({_STEM}), '(tests?|_spec)$') AND NOT starts_with(lower({_STEM}), 'test_')"""))
def _(spark, sf):
    return projected(spark, sf, "files").filter(S.is_server_source(F.col("path"))).select("file_id", "path")


@query("validate_repo_url", r"""SELECT page_id, NULLIF(regexp_extract(u, '^\s*https?://github\.com/([^/\s]+)/([^/\s]+?)(\.git)?(/.*)?\s*$', 1), '') AS owner, NULLIF(regexp_extract(u, '^\s*https?://github\.com/([^/\s]+)/([^/\s]+?)(\.git)?(/.*)?\s*$', 2), '') AS repo
  FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE concat('https://github.com/owner', page_id % 17, '/repo', page_id, CASE WHEN page_id % 2 = 0 THEN '.git' ELSE '' END) END AS u FROM pages)""")
def _(spark, sf):
    u = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://github.com/owner"), F.col("page_id") % 17, F.lit("/repo"), F.col("page_id"), F.when(F.col("page_id") % 2 == 0, ".git").otherwise("")))
    owner, repo = S.repo_owner_and_name(u)
    return table(spark, sf, "pages").select("page_id", owner.alias("owner"), repo.alias("repo"))


@query("manifest_build", with_ctes("files", "SELECT path, file_id AS doc_id, row_number() OVER (ORDER BY path, file_id) - 1 AS file_id FROM files"))
def _(spark, sf):
    rows = projected(spark, sf, "files").select("path", F.col("file_id").alias("doc_id"))
    return T.ranked(rows, ["path", "doc_id"], "file_id").select("path", "doc_id", "file_id")


@query("detect_language", with_ctes("files", f"SELECT file_id, {_lang_case(f'lower({_EXT})')} AS detected FROM files"))
def _(spark, sf):
    return projected(spark, sf, "files").select("file_id", S.detect_language(F.col("path")).alias("detected"))


@query("is_test_path", with_ctes("files", rf"SELECT file_id, regexp_matches(lower(path), '/src/tests?/|/__tests__/|/androidtest/') OR regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(Test\.java|Test\.kt|Tests\.java|_test\.py)$') OR starts_with(regexp_extract(path, '([^/]*)$', 1), 'test_') AS is_test FROM files"))
def _(spark, sf):
    return projected(spark, sf, "files").select("file_id", S.is_test_path(F.col("path")).alias("is_test"))


@query("file_fingerprint", "SELECT sha256(string_agg(h, '' ORDER BY doc_id)) AS sha256, count(*) AS n FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def _(spark, sf):
    rows = table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), F.sha2("text", 256).alias("sha256"))
    return FS.fingerprint(rows)


@query("lex_tokens", with_ctes("tokens", "SELECT file_id, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, ord, text, CAST(len AS BIGINT) AS len FROM tokens"))
def _(spark, sf):
    return lexed(spark, sf).select("file_id", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "ord", "text", F.col("len").cast("long").alias("len"))


_CLASSED = f"""CASE WHEN text IN ('true', 'false') THEN 'BooleanLiteral' WHEN text = 'null' THEN 'NullLiteral' WHEN text = 'var' THEN 'JavaVarKeyword' WHEN text = '@' THEN 'JavaAnnotationMarker' WHEN text IN ({_sql_in(S.KEYWORDS)}) THEN 'Keyword' WHEN text IN ({_sql_in(S.OPERATORS)}) THEN 'Operator' WHEN text IN ({_sql_in(S.PUNCTUATION)}) THEN 'Punctuation' WHEN regexp_full_match(text, '[0-9]+') THEN 'IntegerLiteral' WHEN regexp_full_match(text, '[A-Za-z_][A-Za-z0-9_]*') THEN 'Identifier' ELSE 'Unknown' END"""


@query("classify_token_java", with_ctes("tokens", f"SELECT {_CLASSED} AS token_type, count(*) AS n FROM tokens GROUP BY 1"))
def _(spark, sf):
    return lexed(spark, sf).groupBy(S.classify_token(F.col("text")).alias("token_type")).agg(F.count("*").alias("n"))


@query("filter_trivia", with_ctes("tokens", f"SELECT file_id, count(*) AS n FROM tokens WHERE {_CLASSED} <> 'Punctuation' GROUP BY file_id"))
def _(spark, sf):
    rows = lexed(spark, sf).withColumn("token_type", F.when(S.classify_token(F.col("text")) == "Punctuation", "Whitespace").otherwise("Identifier"))
    return T.filter_trivia(rows).groupBy("file_id").agg(F.count("*").alias("n"))


@query("tokens_per_file", with_ctes("tokens", "SELECT file_id, CAST(coalesce(sum(n) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_token_id, n AS token_count FROM (SELECT file_id, count(*) AS n FROM tokens GROUP BY file_id)"))
def _(spark, sf):
    return T.tokens_per_file(lexed(spark, sf))


@query("token_id_alloc", with_ctes("tokens", "SELECT file_id, ord, row_number() OVER (ORDER BY file_id, ord) - 1 AS token_id FROM tokens"))
def _(spark, sf):
    return T.tokens_with_ids(table(spark, sf, "documents"), "doc_id").select("file_id", "ord", "token_id")


@query("sort_key", with_ctes("tokens", "SELECT file_id, ord, ((file_id & 65535) << 48) | (CAST(line AS BIGINT) << 24) | ((CAST(col AS BIGINT) & 65535) << 8) AS sort_key FROM tokens"))
def _(spark, sf):
    return lexed(spark, sf).select("file_id", "ord", S.sort_key(F.col("file_id"), F.col("line"), F.col("col"), F.lit(0)).alias("sort_key"))


@query("unpack_sort_key", with_ctes("tokens", "SELECT file_id, ord, file_id & 65535 AS k_file, CAST(line AS BIGINT) AS k_line, CAST(col AS BIGINT) & 65535 AS k_col FROM tokens"))
def _(spark, sf):
    k = S.unpack_sort_key(S.sort_key(F.col("file_id"), F.col("line"), F.col("col"), F.lit(0)))
    return lexed(spark, sf).select("file_id", "ord", k["file_id"].alias("k_file"), k["line"].alias("k_line"), k["col"].alias("k_col"))


@query("dup_ordinal", "SELECT user_id, ts, event_id, (row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) - 1) & 255 AS dup FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("file_id"), F.date_trunc("day", "ts").alias("line"), F.lit(0).alias("col"), F.col("event_id").alias("ord"), "ts")
    return T.dup_ordinal(e).select(F.col("file_id").alias("user_id"), "ts", F.col("ord").alias("event_id"), "dup")


@query("intern_strings", with_ctes("tokens", "SELECT text, row_number() OVER (ORDER BY f, o) - 1 AS text_id, n FROM (SELECT text, min((file_id, ord)) AS m, count(*) AS n, min(file_id) AS f, arg_min(ord, (file_id, ord)) AS o FROM tokens GROUP BY text)"))
def _(spark, sf):
    return T.intern(lexed(spark, sf))


@query("name_index", with_ctes("symbols", "SELECT name, min(sym_id) AS sym_id, count(*) AS n FROM symbols GROUP BY name"))
def _(spark, sf):
    from graphloom.operators.symbols import row_of_name

    return row_of_name(projected(spark, sf, "symbols"))


_NAMED = "list_filter(list(text) OVER (PARTITION BY file_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING), lambda x: regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*') AND NOT x IN ({b}))"


@query("name_lookahead_class", with_ctes("tokens", f"SELECT file_id, ord, text AS keyword, names[1] AS name FROM (SELECT file_id, ord, text, {_NAMED.format(k=15, b=_sql_in(BLOCKED))} AS names FROM tokens) WHERE text IN ({_sql_in(OPENERS)}) AND len(names) > 0"))
def _(spark, sf):
    return T.name_after(lexed(spark, sf), OPENERS, 15, BLOCKED)


@query("decl_sweep", with_ctes("tokens", f"SELECT file_id, name, arg_min(keyword, ord) AS keyword FROM (SELECT file_id, ord, text AS keyword, names[1] AS name FROM (SELECT file_id, ord, text, {_NAMED.format(k=10, b=_sql_in(BLOCKED))} AS names FROM tokens) WHERE text IN ({_sql_in(OPENERS)}) AND len(names) > 0) WHERE regexp_matches(name, '^[A-Z]') GROUP BY file_id, name"))
def _(spark, sf):
    found = T.name_after(lexed(spark, sf), OPENERS, 10, BLOCKED).filter(F.col("name").rlike("^[A-Z]"))
    return found.groupBy("file_id", "name").agg(F.min_by("keyword", "ord").alias("keyword"))


def _before_sql(stops: str) -> str:
    return with_ctes("tokens", f"SELECT t.file_id, CAST(t.line AS BIGINT) AS line, arg_max(t.text, t.ord) AS name FROM tokens t JOIN (SELECT file_id, line, min(ord) AS stop FROM tokens WHERE text IN ({stops}) GROUP BY file_id, line) s USING (file_id, line) WHERE t.ord < s.stop AND regexp_full_match(t.text, '[A-Za-z_][A-Za-z0-9_]*') GROUP BY t.file_id, t.line")


@query("name_before_paren", _before_sql("'.', ','"))
def _(spark, sf):
    return T.name_before(lexed(spark, sf), (".", ",")).select("file_id", F.col("line").cast("long").alias("line"), "name")


@query("name_before_assign", _before_sql("'|', '!'"))
def _(spark, sf):
    return T.name_before(lexed(spark, sf), ("|", "!")).select("file_id", F.col("line").cast("long").alias("line"), "name")


_SRC = "SELECT doc_id AS file_id, concat('package org.', source, '.', lang, '.d', doc_id % 7, ';', chr(10), 'import java.', lang, '.T', doc_id % 5, ';', chr(10), 'import static org.', source, '.x.Y;', chr(10), coalesce(text, '')) AS text FROM documents"


def _with_headers(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("package org."), "source", F.lit("."), "lang", F.lit(".d"), F.col("doc_id") % 7, F.lit(";\nimport java."), "lang", F.lit(".T"), F.col("doc_id") % 5, F.lit(";\nimport static org."), "source", F.lit(".x.Y;\n"), F.coalesce("text", F.lit(""))).alias("text"))


@query("package_sweep", f"""WITH s AS ({_SRC}), p AS (SELECT file_id, string_split(regexp_extract(text, '(?m)^\\s*package\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1), '.') AS a FROM s),
  q AS (SELECT DISTINCT array_to_string(a[1:i], '.') AS qual_name FROM p, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i))
  SELECT qual_name, regexp_extract(qual_name, '([^.]*)$', 1) AS name, NULLIF(regexp_extract(qual_name, '^(.*)\\.[^.]*$', 1), '') AS parent FROM q""")
def _(spark, sf):
    return T.package_prefixes(T.packages(_with_headers(spark, sf)))


@query("import_sweep", f"""WITH s AS ({_SRC}) SELECT file_id, q AS qual_name, regexp_extract(q, '^(.*)\\.[^.]*$', 1) AS package FROM (SELECT file_id, unnest(regexp_extract_all(text, '(?m)^\\s*import\\s+(?:static\\s+)?([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS q FROM s) WHERE regexp_extract(q, '^(.*)\\.[^.]*$', 1) <> ''""")
def _(spark, sf):
    return T.imports(_with_headers(spark, sf))


@query("asof_token", """SELECT e.event_id, p.event_id AS token FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'""")
def _(spark, sf):
    e = table(spark, sf, "events")
    asks = e.filter("event_type = 'view'").select("user_id", "ts", "event_id")
    gives = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("token"))
    return T.asof(asks, gives, ["user_id"], "ts", "token").select("event_id", "token")


@query("message_ordinal", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ordinal FROM conversations")
def _(spark, sf):
    from graphloom.operators.callgraph import message_order

    return message_order(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "ordinal")


@query("sort_tokens", with_ctes("tokens", "SELECT file_id, string_agg(text, ' ' ORDER BY line, col) AS tokens FROM tokens GROUP BY file_id"))
def _(spark, sf):
    by_place = F.array_sort(F.collect_list(F.struct("line", "col", "text")))
    return lexed(spark, sf).groupBy("file_id").agg(F.array_join(F.transform(by_place, lambda x: x["text"]), " ").alias("tokens"))


@query("take_n", with_ctes("symbols", "SELECT sym_id, name FROM symbols WHERE kind = 'CLASS' ORDER BY sym_id LIMIT 6"))
def _(spark, sf):
    return projected(spark, sf, "symbols").filter("kind = 'CLASS'").orderBy("sym_id").select("sym_id", "name").limit(6)


@query("regex_class_oracle", r"""SELECT doc_id, n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^\s*(?:The|Der|La|El)\s+([A-Za-z]+)', 1)) AS n FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:The|Der|La|El)\s+([A-Za-z]+)"), 1)).alias("n"))
