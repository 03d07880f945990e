"""The Java reader, and facts expected of the samples."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.javaparse import cfg
from graphloom.javaparse.parser import flatten, parse, tokenize
from graphloom.engine import ProgramGraph
from graphloom.javaparse.samples import SAMPLES
from graphloom.operators import java

_MADE = {}


def graph(spark):
    if spark.sparkContext.applicationId not in _MADE:
        rows = [(i, p, t) for i, (p, t) in enumerate(sorted(SAMPLES.items()))]
        _MADE[spark.sparkContext.applicationId] = ProgramGraph(spark.createDataFrame(rows, "file_id long, path string, text string"))
    return _MADE[spark.sparkContext.applicationId]


def method(body: str):
    rows = flatten(parse("class A { int f(int n) { " + body + " } }")[1])
    fn = next(r["pre"] for r in rows if r["node_type"] == "METHOD_DECL")
    return cfg.build(rows, fn)


def test_tree_invariants():
    for text in SAMPLES.values():
        rows = flatten(parse(text)[1])
        assert rows[0]["size"] == len(rows)
        assert all(r["parent"] < r["pre"] for r in rows[1:])
        assert not [r for r in rows if r["node_type"] == "UNKNOWN"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc {}()<>;=.,\"'/*\n@:?-+!classif[]0", max_size=80))
def test_no_input_fails(text):
    tokens, root = parse(text)
    assert flatten(root)[0]["size"] >= 1
    assert "".join(t.text for t in tokenize(text, True)) == text


def test_if_else_joins():
    blocks, edges = method("if (n > 0) { n = 1; } else { n = 2; } return n;")
    assert sorted(k for _, _, k in edges) == ["False", "Return", "True", "Uncond", "Uncond"]
    assert sum(x for _, _, _, x in blocks) == 1 and blocks[0][0] == 0


def test_loops_go_back():
    for body in ("while (n > 0) { n--; }", "do { n--; } while (n > 0);", "for (int i = 0; i < n; i++) { n--; }", "for (int x : xs) { n--; }"):
        _, edges = method(body)
        assert [k for _, _, k in edges].count("LoopBack") == 1 and "False" in [k for _, _, k in edges]


def test_labels_and_jumps():
    _, edges = method("a: while (n > 0) { while (n > 1) { break a; } } return n;")
    blocks, e2 = method("a: while (n > 0) { while (n > 1) { continue a; } } return n;")
    assert "Return" in [k for _, _, k in edges]
    assert [k for _, _, k in e2].count("LoopBack") >= 2


def test_try_reaches_its_body_and_handlers():
    blocks, edges = method("try { n = g(n); } catch (E e) { throw e; } finally { n++; } return n;")
    kinds = [k for _, _, k in edges]
    assert kinds.count("Except") == 2 and "Return" in kinds


def test_switch_falls_through():
    _, edges = method("switch (n) { case 1: n = 2; case 2: n = 3; break; default: n = 4; } return n;")
    assert [k for _, _, k in edges].count("Switch") == 3 and "False" not in [k for _, _, k in edges]


def test_facts_of_the_samples(spark):
    g = graph(spark)
    names = {r["sym_id"]: r["name"] for r in g.symbols.collect()}
    th = {(names[r["from_sym"]], names[r["to_sym"]], r["relation"]) for r in g.th_edges.collect()}
    assert {("Ferry", "Boat", "IMPLEMENTS"), ("FerryFactory", "BoatFactory", "EXTENDS"), ("DailyReport", "Report", "EXTENDS"), ("Porter", "RingListener", "IMPLEMENTS")} <= th
    found = {(names[r["class_sym"]], r["pattern"]) for r in g.table("patterns").collect()}
    assert {("Ledger", "singleton"), ("BoatFactory", "factory"), ("LetterBuilder", "builder"), ("Bell", "observer"), ("FareStrategy", "state"), ("Report", "template_method")} <= found
    calls = {(names[r["caller"]], names[r["callee"]]) for r in g.call_edges.collect()}
    assert {("even", "odd"), ("odd", "even"), ("all", "risky")} <= calls
    sizes = {names[r["node"]]: (r["scc_size"], r["scc_class"]) for r in g.scc.collect()}
    assert sizes["even"] == sizes["odd"] == (2, 2) and sizes["risky"] == (1, 0)


def test_every_function_has_one_exit_and_sound_ssa(spark):
    from graphloom.operators import flow

    g = graph(spark)
    assert flow.bad_graphs(g.blocks.select("fn_sym", "block", "is_exit"), g.table("dom")).count() == 0
    assert flow.bad_ssa(g.table("ssa_defs"), g.table("phis"), g.cfg_edges).count() == 0


def test_all_diagrams_in_both_styles(spark):
    from graphloom.operators.diagrams import KINDS

    g = graph(spark)
    for kind in KINDS:
        text = g.diagram(kind)
        assert text.startswith("@startuml") and text.endswith("@enduml"), kind
    assert "Ferry ..|> Boat" in g.diagram("class") and "class Ledger {" in g.diagram("class", "mermaid")


def test_written_and_read_again(spark, tmp_path):
    from graphloom.sources import artifacts

    g = graph(spark)
    tables = {t: g.table(t) for t in ("tokens", "symbols", "call_edges", "phis")}
    artifacts.write(tables, str(tmp_path / "g"))
    for name, df in tables.items():
        again = artifacts.read(spark, str(tmp_path / "g"), name, verify=True)
        assert again.count() == df.count()
    assert {r["name"] for r in artifacts.inspect(spark, str(tmp_path / "g")).collect()} == set(tables)


def test_a_source_tree(spark, tmp_path):
    from graphloom.engine import analyze

    for path, text in SAMPLES.items():
        at = tmp_path / "src" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    (tmp_path / "src" / "notes.txt").write_text("no source")
    g = analyze(spark, str(tmp_path / "src"))
    assert g.files.count() == len(SAMPLES)
    assert {r["lang"] for r in g.files.select("lang").collect()} == {"Java"}
    assert g.classes.filter(F.col("package") == "org.depot").count() > 10


def test_deep_sources_are_read(spark):
    deep = "class A { int f(int n) { return " + "(" * 3000 + "n" + ")" * 3000 + "; } }"
    chain = "class B { int f(int n) { " + " else ".join(f"if (n == {i}) {{ n = {i}; }}" for i in range(2000)) + " return n; } }"
    got = java.parsed(spark.createDataFrame([(0, deep), (1, chain), (2, None)], "file_id long, text string")).collect()
    assert [r.error for r in sorted(got, key=lambda r: r.file_id)] == [None] * 3
    by = {r.file_id: r for r in got}
    assert len(by[1].blocks) > 4000 and len(by[0].tokens) > 6000 and len(by[2].ast) == 1


def test_names_resolve_by_scope_import_and_package(spark):
    files = [
        (0, "package a; public class T { void go() { } static class In { } }"),
        (1, "package b; import a.T; class U { T t; In x; void m() { t.go(); } class In { } }"),
        (2, "package b; class T { void go() { } }"),
        (3, "package b; class V { T t; void m(U u) { t.go(); u.m(); missing(); } }"),
        (4, "package c; import b.*; class W { U u; T t; void m() { u.m(); super.m(); } }"),
    ]
    g = ProgramGraph(spark.createDataFrame([(i, f"f{i}.java", t) for i, t in files], "file_id long, path string, text string"))
    by = {r.sym_id: r for r in g.symbols.collect()}
    type_of = {(r.file_id, r.name): (by[r.type_sym].file_id, by[r.type_sym].name) for r in by.values() if r.kind == "FIELD" and r.type_sym is not None}
    assert type_of == {(1, "t"): (0, "T"), (1, "x"): (1, "In"), (3, "t"): (2, "T"), (4, "u"): (1, "U"), (4, "t"): (2, "T")}
    calls = {(by[r.caller].file_id, by[r.callee].file_id, by[r.callee].name) for r in g.call_edges.collect()}
    assert calls == {(1, 0, "go"), (3, 2, "go"), (3, 1, "m"), (4, 1, "m")}


def test_calls_go_where_the_receiver_can_be(spark):
    text = """class Top { void go() { } void all(Top t) { t.go(); Low x = new Low(); x.go(); Top y = new Mid(); y.go(); } }
class Mid extends Top { void go() { } } class Low extends Mid { void go() { } } class Bare extends Top { void run() { go(); super.go(); } }"""
    g = ProgramGraph(spark.createDataFrame([(0, "Top.java", text)], "file_id long, path string, text string"))
    by = {r.sym_id: r for r in g.symbols.collect()}
    label = lambda s: f"{by[by[s].parent_sym].name}.{by[s].name}"
    sites = {r.site_id: r.first_tok for r in g.call_sites.collect()}
    got = sorted((sites[r.site_id], label(r.caller), label(r.callee)) for r in java.call_edges(g.call_sites, java.listed(g.parsed, "given"), g.symbols, g.th_edges, g.ast, g.chains).collect())
    callees = [[c for t, f, c in got if t == at] for at in sorted({t for t, _, _ in got})]
    assert callees[0] == ["Low.go", "Mid.go", "Top.go"] and callees[1] == ["Low.go"] and callees[2] == ["Mid.go"] and callees[3] == ["Top.go"] and callees[4] == ["Top.go"]
