"""Diagrams as ordered lines of text. Each gives (ord, line); `text` joins them. Members and edges are aggregated in the cluster; a diagram's text is made by one ordered pass at the end.

Records: classes (sym_id, name, stereotype, fields, methods, package), links (src, dst,
relation), activities (fn_sym, name, src, dst), messages (ordinal, src, dst, method),
transitions (class_sym, from_state, to_state, trigger), objects (name, type, method).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators.closure import cut

KINDS = ("class", "object", "component", "deployment", "package", "composite_structure", "profile", "use_case", "activity", "sequence", "state_machine", "timing", "interaction_overview", "communication")
# Arrows by relation.
PLANTUML = {"EXTENDS": "--|>", "IMPLEMENTS": "..|>", "Association": "-->", "Aggregation": "o--", "Composition": "*--", "USES": "..>", "Dependency": "..>"}
MERMAID = {"EXTENDS": "--|>", "IMPLEMENTS": "..|>", "Association": "-->", "Aggregation": "o--", "Composition": "*--", "USES": "..>", "Dependency": "..>"}


def _lines(rows: DataFrame, order: list[Column], lines: Column) -> DataFrame:
    return rows.select(F.array(*order).alias("key"), F.posexplode(lines).alias("i", "line")).select(F.concat("key", F.array(F.lpad(F.col("i").cast("string"), 6, "0"))).alias("ord"), "line")


def _fixed(spark, at: str, *lines: str) -> DataFrame:
    return spark.createDataFrame([([at, "", f"{i:06d}"], x) for i, x in enumerate(lines)], "ord array<string>, line string")


def text(lines: DataFrame) -> DataFrame:
    """One row: the diagram. Lines are sorted and joined by range partitions; only the partitions' texts meet in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            at = batch.column("p")[0].as_py() if at is None and batch.num_rows else at
            parts.append("\n".join(x for x in batch.column("line").to_pylist() if x is not None))
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array(["\n".join(parts)], pa.string())], names=["p", "part"])

    placed = cut(lines.filter("line IS NOT NULL")).repartitionByRange("ord").sortWithinPartitions("ord", "line")
    parts = placed.select(F.spark_partition_id().alias("p"), "line").mapInArrow(work, "p int, part string")
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "part"))), lambda x: x["part"]), "\n").alias("diagram"))


def _drawable(classes: DataFrame) -> DataFrame:
    safe = classes.withColumn("safe", S.sanitize(F.col("name")))
    return safe.filter(~S.is_system_name(F.col("safe")))


def _names(classes: DataFrame, links: DataFrame) -> DataFrame:
    n = _drawable(classes).select("sym_id", "safe")
    return links.join(n.toDF("src", "a"), "src").join(n.toDF("dst", "b"), "dst")


def class_diagram(classes: DataFrame, links: DataFrame, style: str = "plantuml") -> DataFrame:
    spark, mermaid = classes.sparkSession, style == "mermaid"
    members = F.transform(F.concat("fields", F.transform("methods", lambda m: F.concat(m, F.lit("()")))), lambda m: F.concat(F.lit("  "), m))
    head = F.concat(F.lit("class "), F.col("safe")) if mermaid else F.concat(F.when(F.col("stereotype").isin("interface", "enum"), F.col("stereotype")).when(F.col("stereotype") == "abstract", F.lit("abstract class")).otherwise(F.lit("class")), F.lit(" "), F.col("safe"))
    body = _lines(_drawable(classes), [F.lit("1"), F.col("safe")], F.concat(F.array(F.concat(head, F.lit(" {"))), members, F.array(F.lit("}"))))
    arrow = F.create_map(*[x for kv in (MERMAID if mermaid else PLANTUML).items() for x in map(F.lit, kv)])
    edges = _names(classes, links).select("a", "b", F.coalesce(arrow[F.col("relation")], F.lit("-->")).alias("r")).distinct()
    drawn = _lines(edges, [F.lit("2"), F.concat_ws(" ", "a", "r", "b")], F.array(F.concat_ws(" ", "a", "r", "b")))
    start, end = (["classDiagram"], []) if mermaid else (["@startuml"], ["@enduml"])
    out = _fixed(spark, "0", *start).unionByName(body).unionByName(drawn)
    return out.unionByName(_fixed(spark, "9", *end)) if end else out


def object_diagram(objects: DataFrame, style: str = "plantuml") -> DataFrame:
    rows = objects.select("ssa_id", S.sanitize(F.col("type")).alias("t"), S.sanitize(F.col("method")).alias("m"))
    name = F.concat_ws("_", "t", F.col("ssa_id").cast("string"))
    order = [F.lit("1"), F.concat_ws(" ", "t", F.lpad(F.col("ssa_id").cast("string"), 20, "0"))]
    if style == "mermaid":
        lines = F.array(F.concat(F.lit("class "), name, F.lit(" {")), F.concat(F.lit("  allocatedIn = "), F.col("m")), F.lit("}"))
        return _fixed(objects.sparkSession, "0", "classDiagram").unionByName(_lines(rows, order, lines))
    lines = F.array(F.concat(F.lit('object "'), name, F.lit(" : "), F.col("t"), F.lit('"')))
    return _wrapped(objects.sparkSession, _lines(rows, order, lines))


def _wrapped(spark, body: DataFrame) -> DataFrame:
    return _fixed(spark, "0", "@startuml").unionByName(body).unionByName(_fixed(spark, "9", "@enduml"))


def _first(classes: DataFrame, n: int) -> DataFrame:
    """The first n drawable classes; the cap is the diagram's own."""
    return _drawable(classes).orderBy("sym_id").limit(n)


def component_diagram(classes: DataFrame, style: str = "plantuml", most: int = 6) -> DataFrame:
    group = _drawable(classes).groupBy(F.coalesce("package", F.lit("Core")).alias("p")).agg(F.slice(F.array_sort(F.collect_set("safe")), 1, most).alias("cs"))
    open_, item, close = ("subgraph {}", "  {}", "end") if style == "mermaid" else ('package "{}" {{', "  [{}]", "}")
    put = lambda t, c: F.concat(*[F.lit(x) if i % 2 == 0 else c for i, x in enumerate(t.replace("{{", "\1").replace("{}", "\0{}\0").replace("\1", "{").split("\0"))])
    body = _lines(group, [F.lit("1"), F.col("p")], F.concat(F.array(put(open_, F.col("p"))), F.transform("cs", lambda c: put(item, c)), F.array(F.lit(close))))
    return _fixed(classes.sparkSession, "0", "graph TD").unionByName(body) if style == "mermaid" else _wrapped(classes.sparkSession, body)


def deployment_diagram(classes: DataFrame, style: str = "plantuml", most: int = 6) -> DataFrame:
    rows = _first(classes, 2 * most).select("sym_id", "safe")
    from pyspark.sql import Window

    rows = rows.withColumn("k", F.row_number().over(Window.orderBy("sym_id")) - 1)
    side = F.when(F.col("k") < most, "Client").otherwise("Server")
    grouped = rows.groupBy(side.alias("side")).agg(F.array_sort(F.collect_list("safe")).alias("cs"))
    if style == "mermaid":
        body = _lines(grouped, [F.lit("1"), F.col("side")], F.concat(F.array(F.concat(F.lit("subgraph "), "side")), F.transform("cs", lambda c: F.concat(F.lit("  "), c)), F.array(F.lit("end"))))
        return _fixed(classes.sparkSession, "0", "graph LR").unionByName(body).unionByName(_fixed(classes.sparkSession, "2", "Client --> Server"))
    body = _lines(grouped, [F.lit("1"), F.col("side")], F.concat(F.array(F.concat(F.lit("node "), F.col("side"), F.lit(" {"))), F.transform("cs", lambda c: F.concat(F.lit("  artifact "), c)), F.array(F.lit("}"))))
    return _wrapped(classes.sparkSession, body.unionByName(_fixed(classes.sparkSession, "2", "Client --> Server")))


def package_diagram(classes: DataFrame, links: DataFrame, style: str = "plantuml") -> DataFrame:
    per = _drawable(classes).groupBy(F.coalesce("package", F.lit("default")).alias("p")).agg(F.array_sort(F.collect_set("safe")).alias("cs"))
    alias, mermaid = S.package_alias(F.col("p")), style == "mermaid"
    head = F.concat(F.lit("subgraph "), alias, F.lit("["), F.col("p"), F.lit("]")) if mermaid else F.concat(F.lit('package "'), F.col("p"), F.lit('" as '), alias, F.lit(" {"))
    item = (lambda c: F.concat(F.lit("  "), c)) if mermaid else (lambda c: F.concat(F.lit("  class "), c))
    body = _lines(per, [F.lit("1"), F.col("p")], F.concat(F.array(head), F.transform("cs", item), F.array(F.lit("end" if mermaid else "}"))))
    pk = classes.select("sym_id", F.coalesce("package", F.lit("default")).alias("p"))
    across = links.join(pk.toDF("src", "a"), "src").join(pk.toDF("dst", "b"), "dst").filter("a <> b").select(S.package_alias(F.col("a")).alias("a"), S.package_alias(F.col("b")).alias("b")).distinct()
    arrow = "-.->" if mermaid else "..>"
    drawn = _lines(across, [F.lit("2"), F.concat_ws(" ", "a", "b")], F.array(F.concat_ws(" ", F.col("a"), F.lit(arrow), F.col("b"))))
    both = body.unionByName(drawn)
    return _fixed(classes.sparkSession, "0", "flowchart TB").unionByName(both) if mermaid else _wrapped(classes.sparkSession, both)


def composite_structure_diagram(classes: DataFrame, style: str = "plantuml", most: int = 4) -> DataFrame:
    rows = _first(classes, most)
    open_ = F.concat(F.lit("class " if style == "mermaid" else "component "), F.col("safe"), F.lit(" {"))
    part = (lambda f: F.concat(F.lit("  "), f)) if style == "mermaid" else (lambda f: F.concat(F.lit("  ["), F.regexp_replace(f, r"^[+\-#~]", ""), F.lit("]")))
    body = _lines(rows, [F.lit("1"), F.col("safe")], F.concat(F.array(open_), F.transform("fields", part), F.array(F.lit("}"))))
    return _fixed(classes.sparkSession, "0", "classDiagram").unionByName(body) if style == "mermaid" else _wrapped(classes.sparkSession, body)


def profile_diagram(classes: DataFrame, style: str = "plantuml") -> DataFrame:
    used = classes.groupBy("stereotype").agg(F.count("*").alias("n"))
    fmt = "Stereotype_%s -->|%d| Metaclass" if style == "mermaid" else "class %s <<stereotype>>"
    line = F.format_string(fmt, "stereotype", "n") if style == "mermaid" else F.format_string(fmt, "stereotype")
    body = _lines(used, [F.lit("1"), F.col("stereotype")], F.array(line))
    return _fixed(classes.sparkSession, "0", "graph TD").unionByName(body) if style == "mermaid" else _wrapped(classes.sparkSession, body)


def use_case_diagram(entries: DataFrame, style: str = "plantuml", most: int = 5) -> DataFrame:
    """entries: (sym_id, name) of entry points."""
    rows = entries.select("sym_id", S.sanitize(F.col("name")).alias("n")).orderBy("sym_id").limit(most)
    line = F.concat(F.lit("User --> "), F.col("n")) if style == "mermaid" else F.concat(F.lit("User --> ("), F.col("n"), F.lit(")"))
    body = _lines(rows, [F.lit("1"), F.col("n")], F.array(line))
    if style == "mermaid":
        return _fixed(entries.sparkSession, "0", "graph LR").unionByName(body)
    return _fixed(entries.sparkSession, "0", "@startuml", "actor User").unionByName(body).unionByName(_fixed(entries.sparkSession, "9", "@enduml"))


def activity_diagram(edges: DataFrame, style: str = "plantuml") -> DataFrame:
    node = lambda c: F.format_string("Node_%d_%d", F.col("fn_sym"), F.col(c).cast("long"))
    arrow = "-->"
    order = [F.lit("1"), F.concat_ws(" ", F.lpad(F.col("fn_sym").cast("string"), 20, "0"), F.lpad(F.col("src").cast("string"), 9, "0"), F.lpad(F.col("dst").cast("string"), 9, "0"))]
    body = _lines(edges.select("fn_sym", "src", "dst").distinct(), order, F.array(F.concat_ws(" ", node("src"), F.lit(arrow), node("dst"))))
    return _fixed(edges.sparkSession, "0", "graph TD").unionByName(body) if style == "mermaid" else _wrapped(edges.sparkSession, body)


def _message_lines(messages: DataFrame, line: Column) -> DataFrame:
    rows = messages.select("sequence", "ordinal", S.sanitize(F.col("src")).alias("a"), S.sanitize(F.col("dst")).alias("b"), S.sanitize(F.col("method")).alias("m"))
    return _lines(rows, [F.lit("1"), F.concat_ws(" ", F.lpad(F.col("sequence").cast("string"), 20, "0"), F.lpad(F.col("ordinal").cast("string"), 12, "0"))], F.array(line))


def sequence_diagram(messages: DataFrame, style: str = "plantuml") -> DataFrame:
    """messages: (sequence, ordinal, src, dst, method)."""
    body = _message_lines(messages, F.concat(F.col("a"), F.lit("->>" if style == "mermaid" else " -> "), F.col("b"), F.lit(": "), F.col("m"), F.lit("()")))
    return _fixed(messages.sparkSession, "0", "sequenceDiagram", "autonumber").unionByName(body) if style == "mermaid" else _wrapped(messages.sparkSession, body)


def communication_diagram(messages: DataFrame, style: str = "plantuml") -> DataFrame:
    label = F.concat(F.col("ordinal").cast("string"), F.lit(": "), F.col("m"), F.lit("()"))
    line = F.concat(F.col("a"), F.lit(" -->|"), label, F.lit("| "), F.col("b")) if style == "mermaid" else F.concat(F.lit("["), F.col("a"), F.lit("] --> ["), F.col("b"), F.lit("] : "), label)
    body = _message_lines(messages, line)
    return _fixed(messages.sparkSession, "0", "graph LR").unionByName(body) if style == "mermaid" else _wrapped(messages.sparkSession, body)


def state_machine_diagram(transitions: DataFrame, style: str = "plantuml") -> DataFrame:
    """transitions: (class_name, from_state, to_state, trigger_name)."""
    rows = transitions.select(S.sanitize(F.col("class_name")).alias("c"), "from_state", "to_state", S.sanitize(F.col("trigger_name")).alias("t"))
    line = F.concat(F.col("c"), F.lit("_"), F.col("from_state").cast("string"), F.lit(" --> "), F.col("c"), F.lit("_"), F.col("to_state").cast("string"), F.lit(" : "), F.col("t"))
    body = _lines(rows.distinct(), [F.lit("1"), F.concat_ws(" ", "c", "t")], F.array(line))
    return _fixed(transitions.sparkSession, "0", "stateDiagram-v2").unionByName(body) if style == "mermaid" else _wrapped(transitions.sparkSession, body)


def timing_diagram(stages: DataFrame, style: str = "plantuml") -> DataFrame:
    """stages: (ord, name, seconds)."""
    if style == "mermaid":
        return _fixed(stages.sparkSession, "0", "gantt", "dateFormat SS").unionByName(_lines(stages, [F.lit("1"), F.lpad(F.col("ord").cast("string"), 6, "0")], F.array(F.format_string("%s :%ds", "name", F.col("seconds").cast("long")))))
    return _wrapped(stages.sparkSession, _lines(stages, [F.lit("1"), F.lpad(F.col("ord").cast("string"), 6, "0")], F.array(F.format_string("@%d", F.col("ord").cast("long")), F.format_string("stage is %s", "name"))))


def interaction_overview_diagram(stages: DataFrame, style: str = "plantuml") -> DataFrame:
    named = stages.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), " --> ").alias("flow"))
    body = named.select(F.array(F.lit("1"), F.lit(""), F.lit("000000")).alias("ord"), F.col("flow").alias("line"))
    return _fixed(stages.sparkSession, "0", "graph TD").unionByName(body) if style == "mermaid" else _wrapped(stages.sparkSession, body)


def json_classes(classes: DataFrame) -> DataFrame:
    """(sym_id, json): a class and its number of methods."""
    return classes.select("sym_id", F.to_json(F.struct("sym_id", F.size("methods").cast("long").alias("methods"))).alias("json"))


def xmi_classes(classes: DataFrame) -> DataFrame:
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("name", F.lit("")), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    return classes.select("sym_id", F.concat(F.lit('<packagedElement xmi:type="uml:Class" xmi:id="sym_'), F.col("sym_id").cast("string"), F.lit('" name="'), name, F.lit('"/>')).alias("xmi"))


def counts(records: dict[str, DataFrame]) -> DataFrame:
    """(name, n)"""
    from functools import reduce

    return reduce(DataFrame.unionByName, (df.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, df in records.items()))
