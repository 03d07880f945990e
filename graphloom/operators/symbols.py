"""Scopes, name and type resolution, hierarchy and associations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators.closure import closure, reversed_edges

CLASSES = ("CLASS", "INTERFACE", "ENUM", "RECORD")


def by_node(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(node_id, sym_id) of nodes that declare a symbol."""
    return nodes.select("node_id").join(symbols.select("sym_id", F.col("decl_node").alias("node_id")), "node_id")


def children(symbols: DataFrame) -> DataFrame:
    """(parent_sym, sym_id, kind)"""
    return symbols.filter("parent_sym IS NOT NULL").select("parent_sym", "sym_id", "kind")


def scope_chain(scopes: DataFrame) -> DataFrame:
    """(scope_id, outer, dist): a scope and all around it; scopes are (scope_id, parent_scope)."""
    up = scopes.filter("parent_scope IS NOT NULL").select(F.col("scope_id").alias("src"), F.col("parent_scope").alias("dst"))
    found = closure(up, scopes.select(F.col("scope_id").alias("root"), F.col("scope_id").alias("node")))
    return found.select(F.col("root").alias("scope_id"), F.col("node").alias("outer"), "dist")


def resolve_lexical(uses: DataFrame, scopes: DataFrame, declared: DataFrame) -> DataFrame:
    """Adds sym_id: the first declaration (scope_id, name, sym_id, ordinal) of a use's name, from its scope outwards. Uses are (use_id, scope_id, name)."""
    inner = declared.select(F.col("scope_id").alias("outer"), "name", "sym_id", "ordinal")
    found = uses.join(scope_chain(scopes), "scope_id").join(inner, ["outer", "name"])
    best = found.groupBy("use_id").agg(F.min_by("sym_id", F.struct("dist", "ordinal", "sym_id")).alias("sym_id"))
    return uses.join(best, "use_id", "left")


def resolve_import(uses: DataFrame, scopes: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds qual_name: what the nearest scope imports (scope_id, simple_name, qual_name) under a use's name."""
    inner = imports.filter("NOT is_wildcard").select(F.col("scope_id").alias("outer"), F.col("simple_name").alias("name"), "qual_name")
    found = uses.join(scope_chain(scopes), "scope_id").join(inner, ["outer", "name"])
    return uses.join(found.groupBy("use_id").agg(F.min_by("qual_name", F.struct("dist", "qual_name")).alias("qual_name")), "use_id", "left")


def wildcard_imports(scopes: DataFrame, imports: DataFrame) -> DataFrame:
    """(scope_id, qual_name): packages that a scope sees through wildcard imports."""
    inner = imports.filter("is_wildcard").select(F.col("scope_id").alias("outer"), "qual_name")
    return scope_chain(scopes).join(inner, "outer").select("scope_id", "qual_name").distinct()


def resolve_type(uses: DataFrame, lexical: DataFrame, imported: DataFrame) -> DataFrame:
    """(use_id, name, how, target): primitive before lexical before import before standard library before external. lexical (use_id, sym_id) and imported (use_id, qual_name) are the two resolutions."""
    found = uses.join(lexical.select("use_id", "sym_id"), "use_id", "left").join(imported.select("use_id", "qual_name"), "use_id", "left")
    stub = S.lookup(F.col("name"), {f"{p}.{n}": [n] for n, p in S.STUBS.items()})
    primitive = F.col("name").isin(S.PRIMITIVES)
    how = F.when(primitive, "primitive").when(F.col("sym_id").isNotNull(), "lexical").when(F.col("qual_name").isNotNull(), "import").when(stub.isNotNull(), "stub").otherwise("external")
    target = F.when(primitive, F.col("name")).otherwise(F.coalesce(F.col("sym_id").cast("string"), "qual_name", stub, "name"))
    return found.select("use_id", "name", how.alias("how"), target.alias("target"))


def member_types(refs: DataFrame) -> DataFrame:
    """(sym_id, type): a member's type is its first type reference (sym_id, pre, type)."""
    return refs.groupBy("sym_id").agg(F.min(F.struct("pre", "type"))["type"].alias("type"))


def count_params(symbols: DataFrame) -> DataFrame:
    """(sym_id, n): parameters of each callable."""
    own = symbols.filter("kind = 'PARAM'").groupBy(F.col("parent_sym").alias("sym_id")).agg(F.count("*").alias("n"))
    return symbols.filter("kind IN ('METHOD', 'CONSTRUCTOR')").select("sym_id").join(own, "sym_id", "left").select("sym_id", F.coalesce("n", F.lit(0)).alias("n"))


def hierarchy_edges(supers: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_sym, to_sym, relation): a class names (sym_id, super_sym) what it builds on; an interface named by a class is implemented, anything else extended."""
    kinds = symbols.select(F.col("sym_id").alias("super_sym"), F.col("kind").alias("super_kind"))
    rows = supers.join(symbols.select("sym_id", "kind"), "sym_id").join(kinds, "super_sym")
    relation = F.when((F.col("super_kind") == "INTERFACE") & (F.col("kind") != "INTERFACE"), "IMPLEMENTS").otherwise("EXTENDS")
    return rows.select(F.col("sym_id").alias("from_sym"), F.col("super_sym").alias("to_sym"), relation.alias("relation"))


def association_kind(is_external: Column, type_name: Column, is_array: Column, is_final: Column, made_in_constructor: Column) -> Column:
    return F.when(is_external, "Dependency").when(type_name.isin(S.COLLECTIONS) | is_array, "Aggregation").when(is_final & made_in_constructor, "Composition").otherwise("Association")


def associations(symbols: DataFrame) -> DataFrame:
    """(from_sym, to_sym, field_sym, kind, mult_min, mult_max, role) of typed fields; is_final, is_array and made_in_constructor are optional columns."""
    have = lambda c: F.col(c) if c in symbols.columns else F.lit(False)
    fields = symbols.filter("kind = 'FIELD' AND type_sym IS NOT NULL").select(F.col("parent_sym").alias("from_sym"), F.col("type_sym").alias("to_sym"), F.col("sym_id").alias("field_sym"), F.col("name").alias("role"), have("is_final").alias("f"), have("is_array").alias("a"), have("made_in_constructor").alias("m"))
    types = symbols.select(F.col("sym_id").alias("to_sym"), F.col("name").alias("type_name"))
    rows = fields.join(types, "to_sym", "left")
    kind = association_kind(F.col("type_name").isNull(), F.coalesce("type_name", F.lit("")), F.col("a"), F.col("f"), F.col("m"))
    many = kind == "Aggregation"
    return rows.select("from_sym", "to_sym", "field_sym", kind.alias("kind"), F.when(many, 0).otherwise(1).alias("mult_min"), F.when(many, None).otherwise(1).alias("mult_max"), "role")


def subtypes(th_edges: DataFrame, of: DataFrame) -> DataFrame:
    """(root, node, dist): what extends or implements given symbols (root), however far."""
    edges = th_edges.filter("relation IN ('EXTENDS', 'IMPLEMENTS')").select(F.col("to_sym").alias("src"), F.col("from_sym").alias("dst"))
    return closure(edges, of.select("root", F.col("root").alias("node")))


def supertypes(th_edges: DataFrame, of: DataFrame) -> DataFrame:
    edges = th_edges.filter("relation IN ('EXTENDS', 'IMPLEMENTS')").select(F.col("to_sym").alias("src"), F.col("from_sym").alias("dst"))
    return closure(reversed_edges(edges), of.select("root", F.col("root").alias("node")))


def qualified_names(symbols: DataFrame) -> DataFrame:
    """(sym_id, qual_name): names from the outermost symbol inwards."""
    up = symbols.filter("parent_sym IS NOT NULL").select(F.col("sym_id").alias("src"), F.col("parent_sym").alias("dst"))
    chain = closure(up, symbols.select(F.col("sym_id").alias("root"), F.col("sym_id").alias("node")))
    named = chain.join(symbols.select(F.col("sym_id").alias("node"), "name"), "node")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "name")))
    return named.groupBy(F.col("root").alias("sym_id")).agg(F.array_join(F.transform(parts, lambda x: x["name"]), ".").alias("qual_name"))


def orphans(symbols: DataFrame) -> DataFrame:
    """Methods and fields whose parent is missing: should be none."""
    return symbols.filter("kind IN ('METHOD', 'FIELD')").join(symbols.select(F.col("sym_id").alias("_p")), F.col("parent_sym") == F.col("_p"), "left_anti").select("sym_id")


#: Tokens behind a symbol's first that may name it.
NAME_REACH = 20


def resolve_names(symbols: DataFrame, tokens: DataFrame, packages: DataFrame) -> DataFrame:
    """(sym_id, name): a symbol's own name; where it is empty or Unknown the first word among its tokens (token_id, text, token_type) that is no keyword or annotation, else its package's name (sym_id, package), else Unknown."""
    own = F.when((F.col("name") != "") & (F.col("name") != "Unknown"), F.col("name"))
    rows = symbols.select("sym_id", own.alias("own"), "first_tok")
    # a symbol asks in the two stretches that its reach lies in; sorted joins, since either side may be large
    block = lambda t: F.floor(t / NAME_REACH)
    asked = rows.filter("own IS NULL AND first_tok IS NOT NULL").select("sym_id", "first_tok", F.explode(F.array(block(F.col("first_tok")), block(F.col("first_tok")) + 1)).alias("block"))
    words = tokens.filter(~F.col("token_type").isin("Keyword", "Annotation") & F.col("text").rlike(r"^[\p{L}_]")).select("token_id", "text", block(F.col("token_id")).alias("block"))
    met = asked.join(words.hint("merge"), "block").filter((F.col("first_tok") <= F.col("token_id")) & (F.col("token_id") < F.col("first_tok") + NAME_REACH))
    found = met.groupBy("sym_id").agg(F.min_by("text", "token_id").alias("word"))
    return rows.join(found.hint("merge"), "sym_id", "left").join(packages.hint("merge"), "sym_id", "left").select("sym_id", F.coalesce("own", "word", "package", F.lit("Unknown")).alias("name"))


def bad_symbols(symbols: DataFrame, th_edges: DataFrame) -> DataFrame:
    """(sym_id, fault): members whose parent is missing, classes whose id repeats, symbols with an edge to none. Should be none."""
    twice = symbols.filter(F.col("kind").isin(*CLASSES)).groupBy("sym_id").agg(F.count("*").alias("n")).filter("n > 1").select("sym_id")
    loose = th_edges.join(symbols.select(F.col("sym_id").alias("_p")), F.col("to_sym") == F.col("_p"), "left_anti").select(F.col("from_sym").alias("sym_id"))
    named = ((orphans(symbols), "orphan"), (twice, "name twice in its scope"), (loose, "edge to nothing"))
    return reduce(DataFrame.unionByName, (df.withColumn("fault", F.lit(fault)) for df, fault in named))


def linked_without(symbols: DataFrame, th_edges: DataFrame, members: DataFrame) -> DataFrame:
    """(sym_id) of classes that a hierarchy edge points to and that own none of the given members."""
    linked = symbols.filter(F.col("kind").isin(*CLASSES)).join(th_edges.select(F.col("to_sym").alias("sym_id")), "sym_id", "left_semi")
    return linked.join(members.select(F.col("parent_sym").alias("sym_id")), "sym_id", "left_anti").select("sym_id")


def class_candidates(symbols: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """Class-like symbols with a drawable name that aren't nested in a method, field, parameter or local (a class may be). stems is (sym_id, stem)."""
    rows = symbols.filter(F.col("kind").isin(*CLASSES))
    rows = rows.join(stems, "sym_id", "left") if stems is not None else rows.withColumn("stem", F.lit(None).cast("string"))
    inner = symbols.filter("kind IN ('METHOD', 'FIELD', 'PARAM', 'LOCAL_VAR')").select(F.col("sym_id").alias("_p"))
    nested = rows.filter("kind <> 'CLASS'").join(inner, F.col("parent_sym") == F.col("_p"), "left_semi").select("sym_id")
    return rows.filter(S.is_class_name(F.col("name"), F.coalesce("stem", F.lit("")))).join(nested, "sym_id", "left_anti").drop("stem")


def first_link(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(sym_id, link): the least link of each symbol, -1 where it has none."""
    return symbols.select("sym_id").join(links.groupBy("sym_id").agg(F.min("link").alias("link")), "sym_id", "left").select("sym_id", F.coalesce("link", F.lit(-1)).alias("link"))


def fuzzy_field_class(fields: DataFrame, classes: DataFrame) -> DataFrame:
    """(sym_id, class_sym): an untyped field's class by name without case and underscores: equal, plural of it, or one the end of the other with four characters at least. The first by name.

    Ends are joined by equality on every end of the longer name, so no pairs of all fields and classes are tried.
    Names are matched once each; no side is broadcast, since ends take many times the room that their table's file does.
    """
    norm = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("")))
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substring(c, i, F.length(c)))
    f = fields.select("sym_id", norm(F.col("name")).alias("f")).withColumn("f", F.explode(F.array_distinct(F.array("f", F.regexp_replace("f", "s$", "")))))
    names = f.select("f").distinct()
    c = classes.select(norm(F.col("name")).alias("c"), F.struct(F.col("name").alias("class_name"), F.col("sym_id").alias("class_sym")).alias("best")).groupBy("c").agg(F.min("best").alias("best"))
    in_field = names.withColumn("e", F.explode(ends(F.col("f")))).filter("length(e) >= 4 OR e = f").join(c.hint("merge"), F.col("e") == F.col("c")).select("f", "best")
    tails = c.withColumn("e", F.explode(ends(F.col("c")))).filter("length(e) >= 4").groupBy("e").agg(F.min("best").alias("best"))
    in_class = names.join(tails.hint("merge"), F.col("f") == F.col("e")).select("f", "best")
    every = in_field.unionByName(in_class).groupBy("f").agg(F.min("best").alias("best"))
    return f.join(every.hint("merge"), "f").groupBy("sym_id").agg(F.min("best")["class_sym"].alias("class_sym"))


def package_of_class(classes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(sym_id, package): the directory of the file named as the class, below java, kotlin or src; else the parent package's name; else the directory of a file whose stem begins with the name; else default."""
    stem = S.file_stem(F.col("path"))
    folder = F.translate(F.regexp_extract("path", r"^(?:.*/)?(?:java|kotlin|src)/(.*)/[^/]*$", 1), "/", ".")
    where = files.select(stem.alias("stem"), F.when(folder == "", F.lit(None)).otherwise(folder).alias("folder")).filter("folder IS NOT NULL")
    own = where.groupBy(F.col("stem").alias("name")).agg(F.min("folder").alias("own"))
    begins = where.filter("length(stem) > 3").withColumn("name", F.explode(F.transform(F.sequence(F.lit(4), F.length("stem")), lambda i: F.substring(F.col("stem"), F.lit(1), i)))).groupBy("name").agg(F.min("folder").alias("begins"))
    parents = symbols.filter("kind = 'PACKAGE'").select(F.col("sym_id").alias("parent_sym"), F.col("name").alias("parent"))
    rows = classes.join(own, "name", "left").join(parents, "parent_sym", "left").join(begins, "name", "left")
    return rows.select("sym_id", F.coalesce("own", "parent", "begins", F.lit("default")).alias("package"))


def type_alias(kind: Column) -> Column:
    return F.lower(kind)


def row_of_name(symbols: DataFrame) -> DataFrame:
    """(name, sym_id, n): an index from names to their least symbol and how many bear them."""
    return symbols.groupBy("name").agg(F.min("sym_id").alias("sym_id"), F.count("*").alias("n"))


def latest_parent(edges: DataFrame) -> DataFrame:
    """(from_sym, extends_sym): of several EXTENDS edges the last by target."""
    return edges.filter("relation = 'EXTENDS'").groupBy("from_sym").agg(F.max("to_sym").alias("extends_sym"))


def ordinals(symbols: DataFrame) -> DataFrame:
    """(sym_id, ordinal): place among the members of one parent."""
    return symbols.filter("parent_sym IS NOT NULL").select("sym_id", (F.row_number().over(Window.partitionBy("parent_sym").orderBy("sym_id")) - 1).cast("long").alias("ordinal"))
