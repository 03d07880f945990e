"""UML records and design patterns as projections and aggregates of the symbol, hierarchy, flow and call tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalar as S

CLASS_KINDS = ("CLASS", "INTERFACE", "ENUM", "RECORD")


def class_metrics(symbols: DataFrame) -> DataFrame:
    """(sym_id, n_fields, n_methods, n_inner) of class-like symbols."""
    own = symbols.groupBy(F.col("parent_sym").alias("sym_id")).agg(F.count_if(F.col("kind") == "FIELD").alias("n_fields"), F.count_if(F.col("kind").isin("METHOD", "CONSTRUCTOR")).alias("n_methods"), F.count_if(F.col("kind").isin(*CLASS_KINDS)).alias("n_inner"))
    return symbols.filter(F.col("kind").isin(*CLASS_KINDS)).select("sym_id").join(own, "sym_id", "left").fillna(0)


def classes(symbols: DataFrame, th_edges: DataFrame) -> DataFrame:
    """(sym_id, name, stereotype, extends_sym, n_implements, fields, methods): nested records, members in order."""
    rows = symbols.filter(F.col("kind").isin(*CLASS_KINDS))
    member = F.struct("ordinal", "sym_id", "name", "visibility")
    pick = lambda *kinds: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), member))), lambda m: F.concat(S.visibility_glyph(m["visibility"]), m["name"]))
    members = symbols.groupBy(F.col("parent_sym").alias("sym_id")).agg(pick("FIELD").alias("fields"), pick("METHOD", "CONSTRUCTOR").alias("methods"))
    extends = th_edges.filter("relation = 'EXTENDS'").groupBy(F.col("from_sym").alias("sym_id")).agg(F.max("to_sym").alias("extends_sym"))
    implements = th_edges.filter("relation = 'IMPLEMENTS'").groupBy(F.col("from_sym").alias("sym_id")).agg(F.count("*").alias("n_implements"))
    stereotype = S.stereotype(F.col("kind"), F.when(F.col("is_abstract"), F.array(F.lit("abstract"))).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    joined = rows.select("sym_id", "name", stereotype.alias("stereotype")).join(extends, "sym_id", "left").join(implements, "sym_id", "left").join(members, "sym_id", "left")
    return joined.select("sym_id", "name", "stereotype", "extends_sym", F.coalesce("n_implements", F.lit(0)).alias("n_implements"), F.coalesce("fields", none).alias("fields"), F.coalesce("methods", none).alias("methods"))


def packages(symbols: DataFrame) -> DataFrame:
    """(sym_id, n_classes, n_packages)"""
    own = symbols.groupBy(F.col("parent_sym").alias("sym_id")).agg(F.count_if(F.col("kind").isin(*CLASS_KINDS)).alias("n_classes"), F.count_if(F.col("kind") == "PACKAGE").alias("n_packages"))
    return symbols.filter("kind = 'PACKAGE'").select("sym_id").join(own, "sym_id", "left").fillna(0)


def components(symbols: DataFrame, th_edges: DataFrame) -> DataFrame:
    """(sym_id, n_provided, n_required): a package's own interfaces, and edges from its classes to other packages' interfaces."""
    provided = symbols.filter("kind = 'INTERFACE'").groupBy(F.col("parent_sym").alias("sym_id")).agg(F.count("*").alias("n_provided"))
    a = symbols.select(F.col("sym_id").alias("from_sym"), F.col("parent_sym").alias("p"))
    b = symbols.filter("kind = 'INTERFACE'").select(F.col("sym_id").alias("to_sym"), F.col("parent_sym").alias("q"))
    required = th_edges.join(a, "from_sym").join(b, "to_sym").filter("p <> q").groupBy(F.col("p").alias("sym_id")).agg(F.count("*").alias("n_required"))
    return symbols.filter("kind = 'PACKAGE'").select("sym_id").join(provided, "sym_id", "left").join(required, "sym_id", "left").fillna(0)


def state_machines(symbols: DataFrame) -> DataFrame:
    """(class_sym, from_state, to_state, trigger): two states and a transition for each method of each class that has one."""
    owners = symbols.filter(F.col("kind").isin(*CLASS_KINDS)).select(F.col("sym_id").alias("parent_sym"))
    return symbols.filter("kind = 'METHOD'").join(owners, "parent_sym", "left_semi").select(F.col("parent_sym").alias("class_sym"), F.lit(0).cast("long").alias("from_state"), F.lit(1).cast("long").alias("to_state"), F.col("sym_id").alias("trigger"))


def activity_nodes(blocks: DataFrame) -> DataFrame:
    """Blocks with degrees to (fn_sym, block, kind)."""
    return blocks.select("fn_sym", "block", S.activity_kind(F.col("block") == 0, F.col("is_exit"), F.col("n_in"), F.col("n_out")).alias("kind"))


def activity_edges(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(fn_sym, src, dst, is_back): an edge goes back if its target dominates its source; dom is (fn_sym, block, dominator)."""
    back = dom.select("fn_sym", F.col("block").alias("src"), F.col("dominator").alias("dst"), F.lit(True).alias("is_back"))
    return edges.join(back, ["fn_sym", "src", "dst"], "left").select("fn_sym", "src", "dst", F.coalesce("is_back", F.lit(False)).alias("is_back"))


def objects(defs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(fn_sym, ssa_id, type_sym): definitions, not phis, whose variable's type is class-like."""
    types = symbols.filter(F.col("kind").isin(*CLASS_KINDS)).select(F.col("sym_id").alias("type_sym"))
    return defs.filter("NOT is_phi").join(types, "type_sym", "left_semi").select("fn_sym", "ssa_id", "type_sym")


def sequences(entries: DataFrame, edges: DataFrame, symbols: DataFrame, most_depth: int) -> DataFrame:
    """(entry, path, from_class, to_class, method): the actor's message to the entry's class, then calls by depth-first order of paths of sites, at most so deep; a method already open is not entered again."""
    owner = symbols.select("sym_id", F.col("parent_sym").alias("cls"))
    front = entries.select(F.col("sym_id").alias("entry"), F.array().cast("array<bigint>").alias("path"), F.array("sym_id").alias("open"))
    first = entries.join(owner, "sym_id").select(F.col("sym_id").alias("entry"), F.array().cast("array<bigint>").alias("path"), F.lit(None).cast("long").alias("from_class"), F.col("cls").alias("to_class"), F.col("sym_id").alias("method"))
    out = first
    for _ in range(most_depth):
        step = front.join(edges, F.element_at("open", -1) == F.col("caller")).filter(~F.array_contains("open", F.col("callee")))
        step = step.select("entry", F.concat("path", F.array("site_id")).alias("path"), "caller", "callee", F.concat("open", F.array("callee")).alias("open"))
        named = step.join(owner.toDF("caller", "from_class"), "caller").join(owner.toDF("callee", "to_class"), "callee")
        out = out.unionByName(named.select("entry", "path", "from_class", "to_class", F.col("callee").alias("method")))
        front = step.select("entry", "path", "open")
    return out


# patterns: (class_sym, pattern, confidence)


def _found(rows: DataFrame, name: str, confidence) -> DataFrame:
    return rows.select(F.col("sym_id").alias("class_sym"), F.lit(name).alias("pattern"), (confidence if not isinstance(confidence, int) else F.lit(confidence)).cast("long").alias("confidence")).distinct()


def _classes(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("kind").isin(*CLASS_KINDS))


def _owning(symbols: DataFrame, members: DataFrame) -> DataFrame:
    return _classes(symbols).join(members.select(F.col("parent_sym").alias("sym_id")).distinct(), "sym_id", "left_semi")


def singleton(symbols: DataFrame) -> DataFrame:
    named = symbols.filter("kind IN ('FIELD', 'METHOD') AND name IN ('instance', 'getInstance')")
    own = symbols.filter("kind = 'FIELD' AND type_sym = parent_sym")
    return _found(_owning(symbols, named.select("parent_sym").unionByName(own.select("parent_sym"))), "singleton", 100)


def observer(symbols: DataFrame) -> DataFrame:
    return _found(_owning(symbols, symbols.filter(F.col("kind").eqNullSafe("METHOD") & F.lower("name").rlike("^(add|register|attach).*listener"))), "observer", 85)


def factory(symbols: DataFrame) -> DataFrame:
    return _found(_classes(symbols).filter(F.lower("name").contains("factory")), "factory", 90)


def fluent_ratio(symbols: DataFrame) -> DataFrame:
    """(sym_id, n_methods, n_fluent): methods of a class, and those that give the class itself back."""
    return symbols.filter("kind = 'METHOD'").groupBy(F.col("parent_sym").alias("sym_id")).agg(F.count("*").alias("n_methods"), F.count_if(F.coalesce(F.col("type_sym") == F.col("parent_sym"), F.lit(False))).alias("n_fluent"))


def builder(symbols: DataFrame) -> DataFrame:
    rows = _classes(symbols).join(fluent_ratio(symbols), "sym_id", "left")
    named, fluent = F.col("name").endswith("Builder"), F.col("n_fluent") / F.col("n_methods") > 0.4
    return _found(rows.filter(named | F.coalesce(fluent, F.lit(False))), "builder", F.when(named, 95).otherwise(75))


def state(symbols: DataFrame) -> DataFrame:
    return _found(_classes(symbols).filter(F.lower("name").rlike("state|strategy")), "state", 85)


def template_method(symbols: DataFrame) -> DataFrame:
    both = symbols.filter("kind = 'METHOD'").groupBy(F.col("parent_sym").alias("sym_id")).agg(F.bool_or("is_abstract").alias("a"), F.bool_or(F.col("visibility") == "protected").alias("p")).filter("a AND p")
    return _found(symbols.filter("kind = 'CLASS' AND is_abstract").join(both, "sym_id", "left_semi"), "template_method", 80)


ORDER = (("singleton", singleton), ("observer", observer), ("factory", factory), ("builder", builder), ("state", state), ("template_method", template_method))


def patterns(symbols: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (f(symbols) for _, f in ORDER))


def pattern_labels(symbols: DataFrame) -> DataFrame:
    """(class_sym, pattern): the first pattern of each class in ORDER."""
    rank = reduce(lambda w, kv: w.when(F.col("pattern") == kv[1][0], kv[0]), enumerate(ORDER), F)
    return patterns(symbols).groupBy("class_sym").agg(F.min_by("pattern", rank).alias("pattern"))


def strict_singleton(symbols: DataFrame) -> DataFrame:
    """Classes with a private static field of their own type, a public static method that gives it, and no public constructor."""
    field = symbols.filter("kind = 'FIELD' AND is_static AND visibility = 'private' AND type_sym = parent_sym").select("parent_sym")
    getter = symbols.filter("kind = 'METHOD' AND is_static AND visibility = 'public' AND type_sym = parent_sym").select("parent_sym")
    open_ = symbols.filter("kind = 'CONSTRUCTOR' AND visibility = 'public'").select(F.col("parent_sym").alias("class_sym"))
    return _found(_owning(symbols, field.intersect(getter)), "strict_singleton", 100).join(open_, "class_sym", "left_anti")


def strict_factory(symbols: DataFrame) -> DataFrame:
    """Classes and interfaces with a method that gives an interface or an abstract type other than their own."""
    broad = symbols.filter("kind = 'INTERFACE' OR is_abstract").select(F.col("sym_id").alias("type_sym"))
    makers = symbols.filter("kind = 'METHOD' AND type_sym <> parent_sym").join(broad, "type_sym", "left_semi").select("parent_sym")
    return _found(_owning(symbols.filter("kind IN ('CLASS', 'INTERFACE')"), makers.distinct()), "strict_factory", 100)


def strict_observer(symbols: DataFrame) -> DataFrame:
    """Classes and interfaces with a method whose name begins with add or remove and holds Listener or Observer."""
    named = symbols.filter("kind = 'METHOD'").filter(F.col("name").rlike("^(add|remove).*(Listener|Observer)")).select("parent_sym")
    return _found(_owning(symbols.filter("kind IN ('CLASS', 'INTERFACE')"), named.distinct()), "strict_observer", 100)


# relations between classes


def priority_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, relation): of several relations of a pair the one of least priority."""
    return edges.groupBy("src", "dst").agg(F.min_by("relation", F.struct("priority", "relation")).alias("relation"))


def optimized_edges(edges: DataFrame) -> DataFrame:
    """(src, relation, dst): inheritance stays; other edges across packages become one import for each pair of packages; those within one bundle to the package's alias. edges are (src, dst, relation, src_package, dst_package)."""
    kept = edges.filter("relation IN ('EXTENDS', 'IMPLEMENTS')").select("src", "relation", "dst")
    other = edges.filter("relation NOT IN ('EXTENDS', 'IMPLEMENTS')")
    across = other.filter("src_package <> dst_package").select(S.package_alias(F.col("src_package")).alias("src"), F.lit("<<imports>>").alias("relation"), S.package_alias(F.col("dst_package")).alias("dst"))
    within = other.filter("src_package = dst_package").select("src", "relation", S.package_alias(F.col("dst_package")).alias("dst"))
    return kept.unionByName(across).unionByName(within).distinct()


def common_scope(edges: DataFrame) -> DataFrame:
    """Adds scope: the deepest package that both ends' packages (src_package, dst_package, dotted) are in, empty at the top."""
    a, b = F.split("src_package", r"\."), F.split("dst_package", r"\.")
    n = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")))["n"]
    return edges.withColumn("scope", F.array_join(F.slice(a, 1, n), "."))


def package_edges(uses: DataFrame) -> DataFrame:
    """(a, b, arrow) of pairs (src, dst): one way -.->, both ways <-.->, each pair once."""
    d = uses.filter("src <> dst").select("src", "dst").distinct()
    pair = d.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), F.min("src").alias("from"))
    return pair.select(F.when(F.col("n") == 2, F.col("a")).otherwise(F.col("from")).alias("a"), F.when(F.col("n") == 2, F.col("b")).when(F.col("from") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("b"), F.when(F.col("n") == 2, "<-.->").otherwise("-.->").alias("arrow"))


def precision_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: counts of correct, phantom and missing keys, precision, recall, F1 and phantom rate; empty denominators give 1, 1, 0, 0."""
    t, f = truth.distinct().withColumn("_t", F.lit(1)), found.distinct().withColumn("_f", F.lit(1))
    both = t.join(f, truth.columns, "full").agg(F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("correct"), F.count_if(F.col("_t").isNull()).alias("phantom"), F.count_if(F.col("_f").isNull()).alias("missing"))
    p = F.when(F.col("correct") + F.col("phantom") > 0, F.col("correct") / (F.col("correct") + F.col("phantom"))).otherwise(F.lit(1.0))
    r = F.when(F.col("correct") + F.col("missing") > 0, F.col("correct") / (F.col("correct") + F.col("missing"))).otherwise(F.lit(1.0))
    rates = both.withColumn("precision", p).withColumn("recall", r)
    return rates.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))).withColumn("phantom_rate", F.when(F.col("correct") + F.col("phantom") > 0, F.col("phantom") / (F.col("correct") + F.col("phantom"))).otherwise(F.lit(0.0)))


def ranked_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))
