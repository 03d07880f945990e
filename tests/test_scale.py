"""What keeps queries within a small driver on large tables: sides that grow aren't broadcast, files are dealt to all tasks."""

from graphloom.engine import ProgramGraph
from graphloom.operators import callgraph, closure, diagrams, java
from graphloom.operators import symbols as Y


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_names_match_without_a_broadcast(spark):
    fields = [(1, "customer_3"), (2, "orders"), (3, "bigorder"), (4, "state"), (5, "ab"), (6, None), (7, "x")]
    classes = [(10, "Customer3"), (11, "Order"), (12, "LightState"), (13, "AB"), (14, "Abs"), (15, "DarkState"), (16, None)]
    found = Y.fuzzy_field_class(spark.createDataFrame(fields, "sym_id long, name string"), spark.createDataFrame(classes, "sym_id long, name string"))
    assert {tuple(r) for r in found.collect()} == {(1, 10), (2, 11), (3, 11), (4, 15), (5, 13)}
    assert "Broadcast" not in plan(found)


def test_names_within_reach_of_a_symbol_without_a_broadcast(spark):
    symbols = [(1, "", 0), (2, "Unknown", 7), (3, "own", 7), (4, "", 40), (5, "Unknown", 41), (6, None, None), (7, "", 99)]
    tokens = [(3, "class", "Keyword"), (5, "9", "IntegerLiteral"), (19, "last", "Identifier"), (26, "next", "Identifier"), (60, "far", "Identifier"), (98, "before", "Identifier")]
    packages = [(4, "org.p"), (3, "org.q")]
    found = Y.resolve_names(spark.createDataFrame(symbols, "sym_id long, name string, first_tok long"), spark.createDataFrame(tokens, "token_id long, text string, token_type string"), spark.createDataFrame(packages, "sym_id long, package string"))
    assert {tuple(r) for r in found.collect()} == {(1, "last"), (2, "last"), (3, "own"), (4, "org.p"), (5, "far"), (6, "Unknown"), (7, "Unknown")}
    assert "Broadcast" not in plan(found)


def test_sources_of_one_partition_are_parsed_by_many_tasks(spark):
    files = spark.createDataFrame([(i, f"class C{i} {{ void m() {{ m(); }} }}") for i in range(40)], "file_id long, text string").coalesce(1)
    found = java.parsed(files)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert {(r.file_id, r.error) for r in found.select("file_id", "error").collect()} == {(i, None) for i in range(40)}


def test_large_written_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(closure, "SMALL", 0)
    rows = closure.cut(spark.range(50))
    found = rows.filter("id % 2 = 0").select("id").join(closure.cut(spark.range(9)), "id")
    assert found.count() == 5 and len(found.collect()) == 5 and "Broadcast" not in plan(found)


def test_spans_come_from_the_lists_of_their_files(spark):
    g = ProgramGraph(spark.createDataFrame([(1, ""), (2, "class A {\n  void m() { m(); }\n}\n"), (3, "class B { }")], "file_id long, text string"))
    assert {tuple(r) for r in g.spans.filter("layer = 'cs'").select("file_id", "line_start", "col_start", "line_end", "col_end").collect()} == {(2, 2, 13, 2, 16)}
    assert {r.file_id for r in g.spans.collect()} == {2, 3}
    ends = ["layer", "entity_id", "first_tok", "last_tok"]
    assert sorted(map(tuple, g.extents.select(*ends).collect())) == sorted(map(tuple, g.spans.select(*ends).collect()))


def test_a_diagram_is_made_in_the_cluster(spark):
    rows = [(["1", f"{k:03d}", f"{i:06d}"], f"line {k} {i}") for k in range(60) for i in range(2)]
    lines = spark.createDataFrame([*rows[::-1], (["0", "", "000000"], "start"), (["9", "", "000000"], "end")], "ord array<string>, line string").repartition(7)
    assert [r.diagram for r in diagrams.text(lines).collect()] == ["\n".join(["start", *(x for _, x in rows), "end"])]
    g = ProgramGraph(spark.createDataFrame([(1, "class A { void m(int n) { if (n > 0) { n--; } } }")], "file_id long, text string"))
    assert g.diagram_row("activity").first().diagram == g.diagram("activity") and g.diagram("activity").count("-->") == 4  # into and past the branch, out of it, to the exit


def test_calls_are_resolved_without_tokens_trees_and_flow(spark):
    text = "package a; class A extends B { A x; int n; void m(int k) { class In { A y; } Runnable r = () -> m(1); x.m(2); new A(); } } class B { }"
    files = spark.createDataFrame([(1, text), (2, None), (3, "class C extends a.A { void q() { m(3); } }")], "file_id long, text string")
    few, whole = ProgramGraph(files), ProgramGraph(files)
    assert whole.parsed is whole.facts
    for name in ("symbols", "th_edges", "call_sites", "call_edges", "chains", "heads"):
        assert sorted(map(str, few.table(name).collect())) == sorted(map(str, whole.table(name).collect())), name
    assert "parsed" not in few.__dict__ and "_facts" not in whole.__dict__
    rows = {r.name: r for r in few.symbols.collect()}
    up = {r.scope_id: r.outer for r in few.chains.filter("dist = 1").collect()}
    assert up[rows["y"].sym_id] == rows["In"].sym_id and up[rows["In"].sym_id] == rows["m"].sym_id == rows["k"].parent_sym
    assert rows["n"].type_sym is None and rows["x"].type_sym == rows["A"].sym_id


def test_packed_lists_open_as_they_were(spark):
    files = spark.createDataFrame([(1, "class A { int m(int n) { while (n > 0) { n--; } return n; } }"), (2, None), (3, "")], "file_id long, text string")
    plain, packed = java.parsed(files), java.parsed(files, java.PACKED)
    for name in java.PACKED:
        assert sorted(map(str, java.listed(packed, name).collect())) == sorted(map(str, java.listed(plain, name).collect())), name
    assert {(r.file_id, r.token_count) for r in java.sizes(packed, "tokens").collect()} == {(r.file_id, len(r.tokens)) for r in plain.collect()}


def test_a_file_whose_flow_fails_keeps_its_names(monkeypatch):
    def fails(*_):
        raise ValueError("no flow")

    monkeypatch.setattr(java.C, "build", fails)
    found, error = java._parsed(1, "class A { void m() { } }", tuple(java.LISTS))
    assert error == "ValueError: no flow" and len(found["decls"]) == 3 and found["tokens"] and "blocks" not in found


def test_matched_reachability_takes_no_round_for_each_call(spark, monkeypatch):
    """Chains of calls of any depth take the same few tables; parts that tasks take whole, bit by bit or one by one, give what rounds give."""
    sites = [(1000 * p + i, 1000 * p + i, 1000 * p + i + 1) for p, n in ((0, 30), (1, 3), (2, 70)) for i in range(n)]
    both = [(s, a, b, False) for s, a, b in sites] + [(s, b, a, True) for s, a, b in sites]
    odd = [(1, 5000, 5010, False), (1, 5011, 5002, True), (2, 5003, 5010, False), (2, 5011, 5004, True), (None, 5002, 5020, False), (None, 5020, 5030, True)]
    calls = spark.createDataFrame(both + odd, "site_id long, src long, dst long, is_return boolean")
    flows = spark.createDataFrame([(5010, 5011)], "src long, dst long")
    seeds = spark.createDataFrame([(x,) for x in (0, 30, 1001, 2070, 5000, 5003, 5020, 9000, 9000)], "root long")
    made = []
    for of in (callgraph, closure):
        monkeypatch.setattr(of, "cut", lambda df, cut=closure.cut: made.append(1) or cut(df))
    found = sorted(map(tuple, callgraph.matched_reachable(calls, flows, seeds).collect()))
    assert len(made) <= 12
    inner = {5010, 5011}
    assert [n for r, n in found if r == 5000] == sorted(inner | {5000, 5002, 5020}) and [n for r, n in found if r == 5020] == [5020, 5030]
    assert [n for r, n in found if r == 30] == list(range(31)) and [n for r, n in found if r == 2070] == list(range(2000, 2071)) and (9000, 9000) in found
    small = calls.filter("src >= 1000 AND src < 2000 OR src >= 5000"), flows, seeds.filter("root >= 1000 AND root < 2000 OR root >= 5000")
    rounds = sorted(map(tuple, callgraph.matched_reachable(*small, gathered=0).collect()))
    assert rounds == [x for x in found if 1000 <= x[0] < 2000 or x[0] >= 5000]


def test_components_of_nodes_in_any_order(spark, monkeypatch):
    """Whatever tasks hang by themselves, torn nodes are joined again."""
    monkeypatch.setattr(closure, "HUNG", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    edges = [(i, (i * 7 + 3) % 61) for i in range(0, 61, 2)] + [(100, 101), (101, 101), (200, 150), (150, 300)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            group = near.get(a, {a}) | near.get(b, {b})
            near |= dict.fromkeys(group, group)
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(9)
    try:
        found = sorted(map(tuple, closure.weak_components(frame).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted((n, min(g)) for n, g in near.items())
