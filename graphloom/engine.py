"""From a tree of Java sources to a program graph, and what may be asked of it."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import bdd, callgraph, closure, diagrams, flow, java, symbols, tokens, trace, uml
from graphloom.sources import artifacts, files


class ProgramGraph:
    """Tables are made when first asked for; every one can be written and read again."""

    def __init__(self, sources: DataFrame):
        self.files = sources
        self.spark = sources.sparkSession

    @cached_property
    def parsed(self) -> DataFrame:
        """Every file parsed with all its lists, written, and read by all tables."""
        return closure.cut(java.parsed(self.files, java.PACKED))

    @cached_property
    def _facts(self) -> DataFrame:
        return closure.cut(java.parsed(self.files, lists=java.FACTS))

    @property
    def facts(self) -> DataFrame:
        """The files by what names and calls are resolved by alone, for questions that need no tokens, trees and control flow; the same as in parsed, which serves where it is made already."""
        return self.parsed if "parsed" in self.__dict__ else self._facts

    @cached_property
    def errors(self) -> DataFrame:
        return java.errors(self.parsed)

    @cached_property
    def first_tokens(self) -> DataFrame:
        """(file_id, first_token_id, token_count) from the lengths of the files' lists."""
        return tokens.first_ids(java.sizes(self.parsed, "tokens"))

    @cached_property
    def tokens(self) -> DataFrame:
        rows = java.listed(self.parsed, "tokens").join(self.first_tokens, "file_id")
        return rows.withColumn("token_id", F.col("first_token_id") + F.col("ord")).drop("first_token_id", "token_count")

    @cached_property
    def ast(self) -> DataFrame:
        return java.listed(self.parsed, "ast")

    @cached_property
    def heads(self) -> DataFrame:
        """The nodes that tell of packages, imports and supertypes; what asks for them may take the whole tree as well."""
        return java.listed(self.facts, "heads")

    @cached_property
    def declared(self) -> DataFrame:
        return closure.cut(java.symbols(self.facts))

    @cached_property
    def chains(self) -> DataFrame:
        return java.chains(self.facts)

    @cached_property
    def symbols(self) -> DataFrame:
        uses = self.declared.select(F.col("sym_id").alias("use_id"), "file_id", F.coalesce("parent_sym", "sym_id").alias("scope"), F.col("type_name").alias("name"))
        types = java.resolved_types(uses, self.declared, self.heads, self.chains)
        return closure.cut(self.declared.join(types.withColumnRenamed("use_id", "sym_id"), "sym_id", "left").withColumn("ordinal", F.col("pre")))

    @cached_property
    def th_edges(self) -> DataFrame:
        return closure.cut(symbols.hierarchy_edges(java.supers(self.heads, self.symbols, self.chains), self.symbols))

    @cached_property
    def associations(self) -> DataFrame:
        return symbols.associations(self.symbols)

    @cached_property
    def blocks(self) -> DataFrame:
        return java.listed(self.parsed, "blocks")

    @cached_property
    def cfg_edges(self) -> DataFrame:
        return java.listed(self.parsed, "cfg_edges")

    @cached_property
    def graphs(self) -> DataFrame:
        return closure.cut(flow.with_statements(flow.graphs(self.blocks, self.cfg_edges), java.listed(self.parsed, "statements")))

    @cached_property
    def sites(self) -> DataFrame:
        """Calls and creations as they stand, before anything is resolved."""
        return closure.cut(java.call_sites(self.facts))

    @cached_property
    def call_sites(self) -> DataFrame:
        return closure.cut(java.typed_sites(self.sites, java.listed(self.facts, "receivers"), self.symbols, self.th_edges, self.heads, self.chains))

    @cached_property
    def call_edges(self) -> DataFrame:
        return closure.cut(callgraph.unique_edges(java.call_edges(self.call_sites, java.listed(self.facts, "given"), self.symbols, self.th_edges, self.heads, self.chains)))

    def _layers(self) -> dict[str, DataFrame]:
        return {"ast": self.ast.withColumnRenamed("node_id", "entity_id"), "sym": self.declared.withColumnRenamed("sym_id", "entity_id"), "cs": self.sites.withColumnRenamed("site_id", "entity_id")}

    @cached_property
    def extents(self) -> DataFrame:
        """(layer, entity_id, file_id, first_tok, last_tok) of nodes, symbols and call sites, without lines and columns."""
        firsts = self.first_tokens.filter("token_count > 0")
        at = lambda df: df.join(firsts, "file_id").withColumns({c: F.col(c) + F.col("first_token_id") for c in ("first_tok", "last_tok")})
        return reduce(DataFrame.unionByName, (at(df).select(F.lit(k).alias("layer"), "entity_id", "file_id", "first_tok", "last_tok") for k, df in self._layers().items()))

    @cached_property
    def spans(self) -> DataFrame:
        """(layer, entity_id, file_id, first_tok, last_tok, lines and columns) of nodes, symbols and call sites."""
        files = java.unpacked(self.parsed, "tokens").join(self.first_tokens.filter("token_count > 0"), "file_id")
        return reduce(DataFrame.unionByName, (trace.located_in_files(k, df, files) for k, df in self._layers().items()))

    @cached_property
    def scc(self) -> DataFrame:
        methods = self.symbols.filter("kind IN ('METHOD', 'CONSTRUCTOR')").select(F.col("sym_id").alias("node"))
        return closure.scc(methods, callgraph.as_edges(self.call_edges))

    @cached_property
    def classes(self) -> DataFrame:
        package = java.packages(self.heads).filter("package <> ''")
        kept = symbols.class_candidates(self.symbols).select("sym_id", "file_id")
        return uml.classes(self.symbols, self.th_edges).join(kept, "sym_id").join(package, "file_id", "left").drop("file_id")

    def table(self, name: str) -> DataFrame:
        made = {"dom": lambda: flow.dominators(self.graphs), "dom_frontier": lambda: flow.dominance_frontier(self.graphs), "loops": lambda: flow.loops(self.graphs), "cdg": lambda: flow.cdg(self.graphs), "ssa_defs": lambda: flow.ssa_defs(self.graphs), "phis": lambda: flow.phis(self.graphs), "def_use": lambda: flow.def_use(self.graphs), "path_metrics": lambda: bdd.path_metrics(self.graphs), "bdd_nodes": lambda: bdd.bdd_nodes(self.graphs), "patterns": lambda: uml.patterns(self.symbols)}
        return made[name]() if name in made else getattr(self, name)

    TABLES = ("tokens", "ast", "symbols", "th_edges", "associations", "blocks", "cfg_edges", "dom", "dom_frontier", "loops", "cdg", "ssa_defs", "phis", "def_use", "call_sites", "call_edges", "scc", "path_metrics", "patterns", "spans", "errors")

    def write(self, path: str, repo_id: str = "repo") -> None:
        artifacts.write({t: self.table(t) for t in self.TABLES}, path, repo_id)

    def named_links(self) -> DataFrame:
        fields = self.associations.filter("to_sym IS NOT NULL").select(F.col("from_sym").alias("src"), F.col("to_sym").alias("dst"), F.col("kind").alias("relation"), F.lit(2).alias("priority"))
        th = self.th_edges.select(F.col("from_sym").alias("src"), F.col("to_sym").alias("dst"), "relation", F.when(F.col("relation") == "EXTENDS", 0).otherwise(1).alias("priority"))
        return uml.priority_edges(th.unionByName(fields))

    def diagram(self, kind: str, style: str = "plantuml") -> str:
        """One of diagrams.KINDS as text, in the driver."""
        return self.diagram_row(kind, style).first()["diagram"]

    def diagram_row(self, kind: str, style: str = "plantuml") -> DataFrame:
        """(diagram): one row, made in the cluster."""
        names = self.declared.select("sym_id", "name")
        if kind in ("class", "package"):
            lines = (diagrams.class_diagram if kind == "class" else diagrams.package_diagram)(self.classes, self.named_links(), style)
        elif kind in ("component", "deployment", "composite_structure", "profile"):
            lines = getattr(diagrams, f"{kind}_diagram")(self.classes, style)
        elif kind == "object":
            made = self.call_sites.filter("node_type = 'NEW_EXPR'").join(names.toDF("caller", "method"), "caller")
            lines = diagrams.object_diagram(made.select(F.col("site_id").alias("ssa_id"), F.col("name").alias("type"), "method"), style)
        elif kind == "use_case":
            lines = diagrams.use_case_diagram(callgraph.entry_points(self.symbols, self.call_edges).join(names, "sym_id"), style)
        elif kind == "activity":
            lines = diagrams.activity_diagram(self.cfg_edges, style)
        elif kind in ("sequence", "communication"):
            s = uml.sequences(callgraph.entry_points(self.symbols, self.call_edges), self.call_edges, self.symbols, 3).filter("from_class IS NOT NULL")
            s = callgraph.message_order(s, "entry", "path").join(names.toDF("from_class", "src"), "from_class").join(names.toDF("to_class", "dst"), "to_class").join(names.toDF("method", "m"), "method")
            lines = getattr(diagrams, f"{kind}_diagram")(s.select(F.col("entry").alias("sequence"), "ordinal", "src", "dst", F.col("m").alias("method")), style)
        elif kind == "state_machine":
            t = uml.state_machines(self.symbols).join(names.toDF("class_sym", "class_name"), "class_sym").join(names.toDF("trigger", "trigger_name"), "trigger")
            lines = diagrams.state_machine_diagram(t, style)
        else:
            stages = self.spark.createDataFrame([(0, "Ingestion", 2.0), (1, "Resolution", 2.0), (2, "Summaries", 3.0)], "ord int, name string, seconds double")
            lines = getattr(diagrams, f"{kind}_diagram")(stages, style)
        return diagrams.text(lines)


def analyze(spark: SparkSession, path: str, rule: str = "cli") -> ProgramGraph:
    return ProgramGraph(files.manifest(files.scan(spark, path, rule)))
