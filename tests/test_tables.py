"""Operators on small tables made by hand, and streaming."""

import random

from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import closure, tokens, tree, uml
from graphloom.streaming import incremental


def test_three_node_tree(spark):
    rows = [(1, i, c == "1", f"n{i}") for i, c in enumerate("110100")]
    parens = spark.createDataFrame(rows, "file_id long, pos long, is_open boolean, name string")
    assert {(r.open_pos, r.close_pos) for r in tree.match_parens(parens).collect()} == {(0, 5), (1, 2), (3, 4)}
    assert [r.rank1 for r in tree.excess(parens).orderBy("pos").collect()] == [1, 2, 2, 3, 3, 3]
    assert [r.pos for r in tree.select1(parens).orderBy("k").collect()] == [0, 1, 3]


def test_lowest_common_ancestor_of_unequal_depths(spark):
    parens = spark.createDataFrame([(1, i, c == "1", "n") for i, c in enumerate("11100100")], "file_id long, pos long, is_open boolean, name string")
    nodes = tree.parents(tree.nodes_of(parens))
    pair = spark.createDataFrame([(1, 2, 3)], "file_id long, a long, b long")
    assert tree.lca(nodes, pair).first()["lca"] == 0
    assert tree.bad_trees(nodes).count() == 0
    got = {(r.pre, r.open_pos, r.close_pos) for r in tree.bp_positions(nodes).collect()}
    assert got == {(r.pre, r.open_pos, r.close_pos) for r in nodes.collect()}


def test_position_key_packs_and_unpacks(spark):
    df = spark.createDataFrame([(0x1234, 0x56789A, 0xABCD, 7)], "f long, l long, c long, d long")
    k = S.unpack_sort_key(S.sort_key(F.col("f"), F.col("l"), F.col("c"), F.col("d")))
    assert tuple(df.select(*[k[x] for x in ("file_id", "line", "col", "dup")]).first()) == (0x1234, 0x56789A, 0xABCD, 7)


def test_dictionary_in_order_of_first_occurrence(spark):
    files = spark.createDataFrame([(0, "class other class"), (1, "third other"), (2, None), (3, "")], "file_id long, text string")
    got = {r.text: r.text_id for r in tokens.intern(tokens.lex(files)).collect()}
    assert got == {"class": 0, "other": 1, "third": 2}


def _components(n, edges):
    reach = {a: {a} for a in range(n)}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            for r in reach.values():
                if a in r and b not in r:
                    r.add(b)
                    moved = True
    return {a: min(b for b in reach[a] if a in reach[b]) for a in range(n)}, reach


def test_components_and_closure_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((6, 9), (14, 20), (20, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        want, reach = _components(n, edges)
        e = spark.createDataFrame(edges, "src long, dst long")
        nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
        for gathered in (1000, 0):
            got = closure.scc(nodes, e, gathered).collect()
            assert {r.node: r.scc_id for r in got} == want and sum(1 for r in got) == n
        found = closure.closure(e, nodes.select(F.col("node").alias("root"), "node")).collect()
        assert {(r.root, r.node) for r in found} == {(a, b) for a in reach for b in reach[a]}


def test_hierarchy_cycle_is_found(spark):
    assert closure.acyclic(spark.createDataFrame([(2, 1), (3, 2)], "src long, dst long"))
    assert not closure.acyclic(spark.createDataFrame([(2, 1), (1, 2)], "src long, dst long"))


def test_depth_counts_by_least_distance(spark):
    e = spark.createDataFrame([(0, 1), (1, 3), (3, 4), (0, 2), (2, 5), (5, 3)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 0)], "root long, node long")
    assert {(r.node, r.dist) for r in closure.closure(e, seeds, 3).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2), (5, 2), (4, 3)}


def test_metrics_of_empty_sets(spark):
    none = spark.createDataFrame([], "k long")
    one = spark.createDataFrame([(1,), (2,)], "k long")
    r = uml.precision_recall(none, none).first()
    assert (r.precision, r.recall, r.f1, r.phantom_rate) == (1.0, 1.0, 1.0, 0.0)
    assert uml.precision_recall(one, one).first().f1 == 1.0


def test_changes_as_a_stream(spark, tmp_path):
    kind = "repo_id string, file_id long, hash string, ts long, text string"
    src = str(tmp_path / "in")
    spark.createDataFrame([("r", 1, "a", 1, "x"), ("r", 1, "b", 2, "y z"), ("r", 2, "c", 1, "w")], kind).write.parquet(src)
    build = lambda df: tokens.lex(df).withColumn("repo_id", F.lit("r")).select("repo_id", "file_id", "ord", "text")
    run = lambda: incremental.start(spark.readStream.schema(kind).parquet(src), str(tmp_path / "out"), build, str(tmp_path / "ck")).awaitTermination()
    run()
    read = lambda: {(r.file_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert read() == {(1, "y"), (1, "z"), (2, "w")}
    spark.createDataFrame([("r", 1, "d", 3, "v")], kind).write.mode("append").parquet(src)
    run()
    assert read() == {(1, "v"), (2, "w")}


def test_windows_over_a_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'view' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'view', 3.0D").write.parquet(src)
    stream = incremental.event_windows(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, float(r.total)) for r in spark.table("windows").collect()] == [("view", 2, 5.0)]


def test_matched_reachability_of_three_nested_calls(spark):
    from graphloom.operators import callgraph

    sites = [(1, 1, 10, False), (2, 10, 20, False), (3, 20, 30, False), (3, 31, 21, True), (2, 21, 11, True), (1, 11, 2, True), (9, 5, 10, False), (9, 11, 6, True)]
    calls = spark.createDataFrame(sites, "site_id long, src long, dst long, is_return boolean")
    flows = spark.createDataFrame([(30, 31)], "src long, dst long")
    got = {tuple(r) for r in callgraph.matched_reachable(calls, flows, spark.createDataFrame([(1,), (10,)], "root long")).collect()}
    inner = {10, 20, 30, 31, 21, 11}
    assert got == {(1, n) for n in inner | {1, 2}} | {(10, n) for n in inner | {2, 6}}


def test_hashes_by_published_vectors(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), ("123456789",)], "s string")
    got = {r.s: (r.f & (1 << 64) - 1, r.c & (1 << 64) - 1, r.k) for r in rows.select("s", S.fnv1a(F.col("s")).alias("f"), S.crc64(F.col("s")).alias("c"), F.crc32(F.col("s").cast("binary")).alias("k")).collect()}
    assert got[""][0] == 0xCBF29CE484222325 and got["a"][0] == 0xAF63DC4C8601EC8C and got["foobar"][0] == 0x85944171F73967E8
    assert got["123456789"][1] == 0x6C40DF5F0B497347 and got["123456789"][2] == 0xCBF43926


def test_composite_hash_is_the_crc_of_the_exclusive_or(spark):
    import zlib

    rows = spark.createDataFrame([(1, 2, 7), (-5, 1 << 40, 3)], "a long, b long, c long")
    got = {(r.a, r.h) for r in rows.select("a", S.composite_hash(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()}
    assert got == {(a, zlib.crc32(((a ^ b ^ c) & (1 << 64) - 1).to_bytes(8, "little"))) for a, b, c in ((1, 2, 7), (-5, 1 << 40, 3))}


def test_tokens_by_a_plain_scan(spark):
    import re

    texts = ["a1 = b;\n\n  x\t+ 22é😀\r\nend", "", "\n", None, "class A {\n}\n"]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    want = []
    for i, text in enumerate(texts):
        n = 0
        for no, line in enumerate((text or "").split("\n"), 1):
            for m in re.finditer(tokens.PATTERN, line):
                if m[0].strip(" \t\r\x0b\x0c"):
                    want.append((i, no, m.start(), n, m[0], len(m[0])))
                    n += 1
    assert sorted(map(tuple, tokens.lex(files).collect())) == want
    ids = tokens.tokens_with_ids(files).orderBy("token_id").collect()
    assert [r.token_id for r in ids] == list(range(len(want))) and [r.text for r in ids] == [w[4] for w in want]


def test_reachability_stops_and_components_are_ordered(spark):
    from graphloom.operators import callgraph

    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 4)], "caller long, callee long")
    pairs = spark.createDataFrame([(1, 5), (5, 1), (6, 6), (6, 1), (2, 1)], "s long, t long")
    assert {(r.s, r.t): r.reachable for r in callgraph.is_reachable(e, pairs).collect()} == {(1, 5): True, (5, 1): False, (6, 6): True, (6, 1): False, (2, 1): True}
    edges = callgraph.as_edges(e)
    found = closure.scc(edges.select(F.col("src").alias("node")).union(edges.select("dst")), edges)
    assert {r.scc_id: r.level for r in closure.scc_levels(found, edges).collect()} == {5: 0, 4: 1, 1: 2, 6: 2}
