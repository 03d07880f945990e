"""Control flow: dominance, loops, liveness, SSA, control dependence, paths.

Each function's graph is small and becomes one row (its edges gathered), so the
graphs of all functions run in parallel through one Arrow pass, without a group
function for each. Block 0 is the entry; an exit is a block without a way on.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Graph = dict[int, list[int]]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0), "array<bigint>": pa.list_(pa.int64()), "array<struct<pred:int,arg:bigint>>": pa.list_(pa.struct([("pred", pa.int32()), ("arg", pa.int64())]))}


def over_functions(gathered: DataFrame, run: Callable[..., Iterator[tuple]], ddl: str) -> DataFrame:
    """run(row as a dictionary) gives tuples for each row of gathered; fn_sym comes first of itself."""
    from pyspark.sql import types as T

    kind = T._parse_datatype_string("fn_sym long, " + ddl)
    names, arrow = kind.names, [_ARROW[f.dataType.simpleString()] for f in kind]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x["fn_sym"], *t) for x in batch.to_pylist() for t in run(x)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow, strict=True)], names=names)

    return gathered.mapInArrow(work, kind)


def graphs(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn_sym, blocks, edges) with edges in order: one row for each function."""
    typed = edges if "edge_type" in edges.columns else edges.withColumn("edge_type", F.lit("Uncond"))
    e = typed.groupBy("fn_sym").agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "edge_type"))).alias("edges"))
    b = blocks.groupBy("fn_sym").agg(F.sort_array(F.collect_list(F.col("block").cast("int"))).alias("blocks"))
    return b.join(e, "fn_sym", "left")


def successors(x: dict) -> Graph:
    out: Graph = {b: [] for b in x["blocks"]}
    for e in x["edges"] or []:
        out[e["src"]].append(e["dst"])
    return out


def predecessors(succ: Graph) -> Graph:
    out: Graph = {b: [] for b in succ}
    for a, bs in succ.items():
        for b in bs:
            out[b].append(a)
    return out


def reverse_postorder(succ: Graph, start: int = 0) -> list[int]:
    seen, order, stack = {start}, [], [(start, iter(succ[start]))]
    while stack:
        node, rest = stack[-1]
        for b in rest:
            if b not in seen:
                seen.add(b)
                stack.append((b, iter(succ[b])))
                break
        else:
            order.append(node)
            stack.pop()
    return order[::-1]


def immediate_dominators(succ: Graph, start: int = 0) -> dict[int, int]:
    """By intersecting dominator chains in reverse postorder until nothing moves; the start dominates itself."""
    order = reverse_postorder(succ, start)
    place = {b: i for i, b in enumerate(order)}
    pred, idom, moved = predecessors(succ), {start: start}, True
    while moved:
        moved = False
        for b in order[1:]:
            new = None
            for p in pred[b]:
                if p in idom:
                    if new is None:
                        new = p
                    else:
                        q = p
                        while q != new:
                            while place[q] > place[new]:
                                q = idom[q]
                            while place[new] > place[q]:
                                new = idom[new]
            if idom.get(b) != new:
                idom[b], moved = new, True
    return idom


def post_dominators(succ: Graph) -> dict[int, int | None]:
    """Immediate postdominators; None stands for the common end behind all exits. Blocks that reach no exit have none."""
    end = max(succ, default=0) + 1
    back = {**{b: [] for b in succ}, end: [b for b, s in succ.items() if not s]}
    for a, bs in succ.items():
        for b in bs:
            back[b].append(a)
    found = immediate_dominators(back, end)
    return {b: (None if d == end else d) for b, d in found.items() if b != end}


def frontiers(succ: Graph, idom: dict[int, int]) -> dict[int, set[int]]:
    out: dict[int, set[int]] = defaultdict(set)
    for b, ps in predecessors(succ).items():
        ps = [p for p in ps if p in idom]
        if b in idom and (len(ps) >= 2 or (b == 0 and ps)):
            for p in ps:
                at = p
                while at != idom[b] or (b == 0 and at == 0):
                    out[at].add(b)
                    if at == idom[at]:
                        break
                    at = idom[at]
    return out


def natural_loops(succ: Graph) -> dict[int, set[int]]:
    """Header -> body, of back edges (edges to a block that dominates their source)."""
    idom, pred, out = immediate_dominators(succ), predecessors(succ), {}
    for a in idom:
        for h in succ[a]:
            up = a
            while up != h and up != idom[up]:
                up = idom[up]
            if up == h:
                body, stack = out.setdefault(h, {h}), [a]
                while stack:
                    b = stack.pop()
                    if b not in body:
                        body.add(b)
                        stack += [p for p in pred[b] if p in idom]
    return out


def longest_path(succ: Graph) -> int:
    """Blocks on the longest path from the entry once back edges are left out."""
    order = reverse_postorder(succ)
    place, best = {b: i for i, b in enumerate(order)}, dict.fromkeys(order, 1)
    for b in order:
        for s in succ[b]:
            if place[s] > place[b]:
                best[s] = max(best[s], best[b] + 1)
    return max(best.values())


def acyclic_paths(succ: Graph) -> int:
    """Paths from the entry to blocks without a way on, back edges left out."""
    order = reverse_postorder(succ)
    place, ways = {b: i for i, b in enumerate(order)}, {}
    for b in reversed(order):
        on = [s for s in succ[b] if place[s] > place[b]]
        ways[b] = sum(ways[s] for s in on) if on else 1
    return ways[0]


def live_in(succ: Graph, uses: dict[int, set[str]], kills: dict[int, set[str]]) -> dict[int, set[str]]:
    """Variables used before they are set, in a block or after it."""
    into = {b: set(uses.get(b, ())) for b in succ}
    pred, work = predecessors(succ), list(succ)
    while work:
        b = work.pop()
        new = set(uses.get(b, ())) | (set().union(*(into[s] for s in succ[b])) - kills.get(b, set()))
        if new != into[b]:
            into[b] = new
            work += pred[b]
    return into


def phi_blocks(succ: Graph, defs: dict[str, set[int]], alive: dict[int, set[str]] | None) -> dict[str, set[int]]:
    """By variable the blocks that need a phi: the iterated frontier of its definitions, where it is alive."""
    idom = immediate_dominators(succ)
    front, out = frontiers(succ, idom), {}
    for v, blocks in defs.items():
        placed: set[int] = set()
        work = [b for b in blocks if b in idom]
        while work:
            for f in front.get(work.pop(), ()):
                if f not in placed and (alive is None or v in alive.get(f, ())):
                    placed.add(f)
                    work.append(f)
        out[v] = placed
    return out


def to_ssa(succ: Graph, stmts: dict[int, list[tuple[int, list[str], list[str]]]]) -> tuple[list, list, list]:
    """Definitions (ssa_id, var, version, stmt, block, is_phi), phis (ssa_id, block, var, [(pred, arg)]) and uses (ssa_id, stmt). stmts: by block, in order, (stmt, uses, defs). An argument or use without a definition in reach is None or left out."""
    uses: dict[int, set[str]] = defaultdict(set)
    kills: dict[int, set[str]] = defaultdict(set)
    defs: dict[str, set[int]] = defaultdict(set)
    for b, rows in stmts.items():
        for _, use, define in rows:
            uses[b] |= set(use) - kills[b]
            kills[b] |= set(define)
            for v in define:
                defs[v].add(b)
    idom, pred = immediate_dominators(succ), predecessors(succ)
    where = phi_blocks(succ, defs, live_in(succ, uses, kills))
    at: dict[int, list[str]] = defaultdict(list)
    for v in sorted(where):
        for b in where[v]:
            at[b].append(v)
    below: Graph = defaultdict(list)
    for b, d in idom.items():
        if b != d:
            below[d].append(b)
    versions: dict[str, int] = defaultdict(int)
    stacks: dict[str, list[int]] = defaultdict(list)
    out_defs, out_uses, args, phi_ids = [], [], defaultdict(list), {}

    def define(v: str, stmt: int | None, b: int, phi: bool) -> int:
        n = len(out_defs)
        out_defs.append((n, v, versions[v], stmt, b, phi))
        versions[v] += 1
        stacks[v].append(n)
        return n

    for b in sorted(idom):
        for v in at[b]:
            phi_ids[b, v] = None
    todo: list[tuple[int, list[str] | None]] = [(0, None)]
    while todo:
        b, pushed = todo.pop()
        if pushed is not None:
            for v in reversed(pushed):
                stacks[v].pop()
            continue
        pushed = []
        for v in at[b]:
            phi_ids[b, v] = define(v, None, b, True)
            pushed.append(v)
        for stmt, use, made in stmts.get(b, []):
            out_uses += [(stacks[v][-1], stmt) for v in dict.fromkeys(use) if stacks[v]]
            for v in made:
                define(v, stmt, b, False)
                pushed.append(v)
        for s in dict.fromkeys(succ[b]):
            for v in at[s]:
                args[s, v].append((b, stacks[v][-1] if stacks[v] else None))
        todo.append((b, pushed))
        todo += [(c, None) for c in sorted(below[b], reverse=True)]
    phis = [(i, b, v, sorted(args[b, v], key=lambda x: x[0])) for (b, v), i in phi_ids.items()]
    return out_defs, phis, out_uses


def control_dependence(x: dict) -> Iterator[tuple[int, int, str]]:
    """For every branch edge, what stands between its target and what postdominates its source; a False edge labels FALSE, any other TRUE."""
    succ = successors(x)
    ipdom, seen = post_dominators(succ), set()
    for e in x["edges"] or []:
        a, at = e["src"], e["dst"]
        if len(set(succ[a])) < 2 or a not in ipdom:
            continue
        while at is not None and at != ipdom[a] and at in ipdom:
            row = (a, at, "FALSE" if e["edge_type"] == "False" else "TRUE")
            if row not in seen:
                seen.add(row)
                yield row
            at = ipdom[at]


# over tables


def rpo(gathered: DataFrame) -> DataFrame:
    return over_functions(gathered, lambda x: ((b, i) for i, b in enumerate(reverse_postorder(successors(x)))), "block int, rpo int")


def dominators(gathered: DataFrame) -> DataFrame:
    """(fn_sym, block, idom, ipdom) of blocks that the entry reaches."""

    def run(x):
        succ = successors(x)
        after = post_dominators(succ)
        return ((b, d, after.get(b)) for b, d in sorted(immediate_dominators(succ).items()))

    return over_functions(gathered, run, "block int, idom int, ipdom int")


def dominance_frontier(gathered: DataFrame) -> DataFrame:
    def run(x):
        succ = successors(x)
        return ((b, f) for b, fs in sorted(frontiers(succ, immediate_dominators(succ)).items()) for f in sorted(fs))

    return over_functions(gathered, run, "block int, frontier int")


def loops(gathered: DataFrame) -> DataFrame:
    """(fn_sym, header, block, depth): bodies of loops and how many loops a block is in."""

    def run(x):
        found = natural_loops(successors(x))
        return ((h, b, sum(b in o for o in found.values())) for h, body in sorted(found.items()) for b in sorted(body))

    return over_functions(gathered, run, "header int, block int, depth int")


def cdg(gathered: DataFrame) -> DataFrame:
    return over_functions(gathered, control_dependence, "controller int, dependent int, label string")


def path_lengths(gathered: DataFrame) -> DataFrame:
    """(fn_sym, max_path_len, acyclic_path_count)"""
    from decimal import Decimal

    def run(x):
        succ = successors(x)
        yield longest_path(succ), Decimal(min(acyclic_paths(succ), 2**64 - 1))

    return over_functions(gathered, run, "max_path_len int, acyclic_path_count decimal(20,0)")


def _by_block(x: dict) -> dict[int, list[tuple[int, list[str], list[str]]]]:
    out: dict[int, list] = defaultdict(list)
    for s in sorted(x["stmts"] or [], key=lambda s: s["stmt"]):
        out[s["block"]].append((s["stmt"], s["uses"] or [], s["defs"] or []))
    return out


def with_statements(gathered: DataFrame, stmts: DataFrame) -> DataFrame:
    """Adds stmts, a list of (stmt, block, uses, defs), to gathered graphs."""
    rows = stmts.groupBy("fn_sym").agg(F.collect_list(F.struct(F.col("stmt").cast("long").alias("stmt"), F.col("block").cast("int").alias("block"), "uses", "defs")).alias("stmts"))
    return gathered.join(rows, "fn_sym", "left")


def liveness(gathered: DataFrame) -> DataFrame:
    """(fn_sym, block, var, live_in, live_out)"""

    def run(x):
        succ, rows = successors(x), _by_block(x)
        uses, kills = defaultdict(set), defaultdict(set)
        for b, ss in rows.items():
            for _, use, made in ss:
                uses[b] |= set(use) - kills[b]
                kills[b] |= set(made)
        into = live_in(succ, uses, kills)
        for b in succ:
            out = set().union(*(into[s] for s in succ[b]))
            yield from ((b, v, v in into[b], v in out) for v in sorted(into[b] | out))

    return over_functions(gathered, run, "block int, var string, live_in boolean, live_out boolean")


def ssa_defs(gathered: DataFrame) -> DataFrame:
    return over_functions(gathered, lambda x: to_ssa(successors(x), _by_block(x))[0], "ssa_id long, var string, version int, def_stmt long, def_block int, is_phi boolean")


def phis(gathered: DataFrame) -> DataFrame:
    run = lambda x: ((i, b, v, [{"pred": p, "arg": a} for p, a in args]) for i, b, v, args in to_ssa(successors(x), _by_block(x))[1])
    return over_functions(gathered, run, "ssa_id long, block int, var string, args array<struct<pred:int,arg:long>>")


def def_use(gathered: DataFrame) -> DataFrame:
    return over_functions(gathered, lambda x: to_ssa(successors(x), _by_block(x))[2], "ssa_id long, use_stmt long")


# relational


def cyclomatic(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn_sym, cyclomatic): edges less blocks plus two, one at least."""
    n = blocks.groupBy("fn_sym").agg(F.count("*").alias("n"))
    e = edges.groupBy("fn_sym").agg(F.count("*").alias("e"))
    return n.join(e, "fn_sym", "left").select("fn_sym", F.greatest(F.coalesce("e", F.lit(0)) - F.col("n") + 2, F.lit(1)).alias("cyclomatic"))


def degrees(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks with n_in and n_out."""
    out = edges.groupBy("fn_sym", F.col("src").alias("block")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy("fn_sym", F.col("dst").alias("block")).agg(F.count("*").alias("n_in"))
    return blocks.join(out, ["fn_sym", "block"], "left").join(into, ["fn_sym", "block"], "left").fillna(0, ["n_in", "n_out"])


def bad_graphs(blocks: DataFrame, dom: DataFrame) -> DataFrame:
    """Blocks of functions with no exit, and blocks that the entry reaches but nothing dominates: should be none."""
    without = blocks.groupBy("fn_sym").agg(F.max(F.col("is_exit").cast("int")).alias("x")).filter("x = 0").select("fn_sym", F.lit(None).cast("int").alias("block"))
    loose = dom.filter("idom IS NULL").select("fn_sym", F.col("block").cast("int"))
    return without.unionByName(loose)


def bad_ssa(defs: DataFrame, phis_: DataFrame, edges: DataFrame) -> DataFrame:
    """Definitions whose id repeats, and phis without an argument for each predecessor: should be none."""
    twice = defs.groupBy("fn_sym", "ssa_id").agg(F.count("*").alias("n")).filter("n > 1").select("fn_sym", "ssa_id")
    preds = edges.groupBy("fn_sym", F.col("dst").alias("block")).agg(F.countDistinct("src").alias("n"))
    short = phis_.join(preds, ["fn_sym", "block"], "left").filter(F.size("args") != F.coalesce("n", F.lit(0))).select("fn_sym", "ssa_id")
    return twice.unionByName(short)


def facts(uses: DataFrame, sources: DataFrame, flows: DataFrame) -> DataFrame:
    """(fn_sym, ssa_id, analysis, value): source facts (fn_sym, ssa_id, analysis, value) carried along flows (fn_sym, src, dst) from a definition to what is computed from it. uses limits the outcome to definitions (fn_sym, ssa_id) that exist."""
    from graphloom.operators.closure import closure

    key = lambda c: F.struct("fn_sym", F.col(c).alias("i"))
    seeds = sources.select(F.struct("analysis", "value").alias("root"), key("ssa_id").alias("node"))
    found = closure(flows.select(key("src").alias("src"), key("dst").alias("dst")), seeds)
    return found.select("node.fn_sym", F.col("node.i").alias("ssa_id"), "root.analysis", "root.value").join(uses, ["fn_sym", "ssa_id"], "left_semi")

