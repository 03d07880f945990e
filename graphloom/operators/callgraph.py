"""Call sites, target resolution, call edges and what is asked of them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.closure import closure, cut, reversed_edges, weak_components


def as_edges(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


def unique_edges(calls: DataFrame) -> DataFrame:
    """(caller, callee, site_id, edge_type): one edge for each pair, the first site's."""
    return calls.groupBy("caller", "callee").agg(F.min("site_id").alias("site_id"), F.min_by("edge_type", "site_id").alias("edge_type"))


def adjacency(edges: DataFrame, by: str = "caller") -> DataFrame:
    """(sym, neighbours, n) in ascending order."""
    other = "callee" if by == "caller" else "caller"
    return edges.groupBy(F.col(by).alias("sym")).agg(F.sort_array(F.collect_set(other)).alias("neighbours")).withColumn("n", F.size("neighbours").cast("long"))


def count_args(sites: DataFrame) -> DataFrame:
    """(site_id, arg_count): children less the callee itself."""
    return sites.select("site_id", F.greatest(F.col("n_children") - 1, F.lit(0)).alias("arg_count"))


def entry_points(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Public or package callables that nothing calls."""
    called = edges.select(F.col("callee").alias("sym_id"))
    return symbols.filter("kind IN ('METHOD', 'CONSTRUCTOR') AND visibility IN ('public', 'package')").join(called, "sym_id", "left_anti").select("sym_id")


def resolve_cha(sites: DataFrame, symbols: DataFrame, th_edges: DataFrame) -> DataFrame:
    """(site_id, callee, is_fallback): the methods of a site's name (site_id, type_sym, name, target) in its declared type and all below it, abstract ones left out; the site's own target where there is none."""
    types = sites.select(F.col("type_sym").alias("root")).filter("root IS NOT NULL").distinct()
    edges = th_edges.filter("relation IN ('EXTENDS', 'IMPLEMENTS')").select(F.col("to_sym").alias("src"), F.col("from_sym").alias("dst"))
    below = closure(edges, types.select("root", F.col("root").alias("node"))).select(F.col("root").alias("type_sym"), F.col("node").alias("parent_sym"))
    methods = symbols.filter("kind = 'METHOD' AND NOT is_abstract").select("parent_sym", "name", F.col("sym_id").alias("callee"))
    found = sites.join(below, "type_sym").join(methods, ["parent_sym", "name"]).select("site_id", "callee").distinct()
    left = sites.filter("target IS NOT NULL").join(found, "site_id", "left_anti").select("site_id", F.col("target").alias("callee"), F.lit(True).alias("is_fallback"))
    return found.withColumn("is_fallback", F.lit(False)).unionByName(left)


def resolve_1cfa(sites: DataFrame, points_to: DataFrame, symbols: DataFrame) -> DataFrame:
    """(site_id, callee): methods of a site's name in the types its receiver (fn_sym, receiver) points to."""
    methods = symbols.filter("kind = 'METHOD'").select(F.col("parent_sym").alias("type_sym"), "name", F.col("sym_id").alias("callee"))
    return sites.join(points_to.select("fn_sym", F.col("var").alias("receiver"), "type_sym"), ["fn_sym", "receiver"]).drop("type_sym_").join(methods, ["type_sym", "name"]).select("site_id", "callee").distinct()


def resolve_sites(sites: DataFrame, one_cfa: DataFrame, cha: DataFrame) -> DataFrame:
    """(site_id, callee, edge_type): direct, special and constructor calls take their target, virtual and interface calls the receiver's methods or else the hierarchy's, dynamic ones their target."""
    direct = sites.filter("call_type NOT IN ('VIRTUAL', 'INTERFACE') AND target IS NOT NULL").select("site_id", F.col("target").alias("callee"), F.col("call_type").alias("edge_type"))
    open_ = sites.filter("call_type IN ('VIRTUAL', 'INTERFACE')").select("site_id", F.col("call_type").alias("edge_type"))
    exact = open_.join(one_cfa, "site_id").select("site_id", "callee", "edge_type")
    rest = open_.join(one_cfa.select("site_id").distinct(), "site_id", "left_anti").join(cha.select("site_id", "callee"), "site_id").select("site_id", "callee", "edge_type")
    return direct.unionByName(exact).unionByName(rest)


def points_to(allocations: DataFrame, copies: DataFrame) -> DataFrame:
    """(fn_sym, var, type_sym): types that variables may hold; allocations (fn_sym, var, type_sym) flow along copies (fn_sym, src, dst). Variables belong to their function."""
    key = lambda c: F.struct("fn_sym", F.col(c).alias("v"))
    edges = copies.select(key("src").alias("src"), key("dst").alias("dst"))
    seeds = allocations.select(F.col("type_sym").alias("root"), key("var").alias("node"))
    return closure(edges, seeds).select("node.fn_sym", F.col("node.v").alias("var"), F.col("root").alias("type_sym"))


def is_reachable(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s, t, reachable) for pairs (s, t); a symbol reaches itself."""
    wanted = pairs.select(F.col("s").alias("root"), F.col("t").alias("node")).distinct()
    found = closure(as_edges(edges), wanted.select("root", F.col("root").alias("node")).distinct(), targets=wanted).select(F.col("root").alias("s"), F.col("node").alias("t"), F.lit(True).alias("reachable"))
    return pairs.join(found, ["s", "t"], "left").select("s", "t", F.coalesce("reachable", F.lit(False)).alias("reachable"))


#: Edges and seeds of a weak component that one task may take whole; larger ones go by rounds over all tasks.
GATHERED = 2_000
_FLOW, _CALL, _RETURN, _SEED = range(4)


def matched_reachable(calls: DataFrame, flows: DataFrame, seeds: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """(root, node): reachable from seeds (root) along flows (src, dst) and calls (site_id, src, dst, is_return) where every return goes to the site that called, however deep. A call that returns becomes a step over its site; what is left of a path goes up by returns to unknown callers first, then down into calls.

    A path stays in its weak component. Those of a bounded number of rows are solved whole, all in parallel.
    """
    kind = F.when(F.col("is_return"), _RETURN).otherwise(_CALL)
    none = F.lit(None).cast("long")
    rows = calls.select(kind.alias("kind"), *(F.col(c).cast("long") for c in ("site_id", "src", "dst")))
    rows = rows.unionByName(flows.select(F.lit(_FLOW).alias("kind"), none.alias("site_id"), F.col("src").cast("long"), F.col("dst").cast("long"))).filter("src IS NOT NULL AND dst IS NOT NULL")
    weak = weak_components(rows)
    own = F.col("root").cast("long")
    rows = rows.unionByName(seeds.filter("root IS NOT NULL").select(F.lit(_SEED).alias("kind"), none.alias("site_id"), own.alias("src"), own.alias("dst")))
    placed = cut(rows.join(weak, F.col("src") == F.col("node"), "left").select(F.coalesce("root", "src").alias("part"), "kind", "site_id", "src", "dst"))
    many = cut(placed.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > gathered).select("part"))
    if many.isEmpty():
        return _matched_in_parts(placed)
    found = _matched_in_parts(placed.join(many, "part", "left_anti"))
    large = cut(placed.join(many, "part", "left_semi"))
    of = lambda *kinds: large.filter(F.col("kind").isin(*kinds))
    return found.unionByName(_matched_by_rounds(of(_CALL, _RETURN).withColumn("is_return", F.col("kind") == _RETURN), of(_FLOW), of(_SEED).select(F.col("src").alias("root"))))


def _matched_in_parts(placed: DataFrame) -> DataFrame:
    return placed.repartition("part").sortWithinPartitions("part").mapInArrow(_matched, "root long, node long")


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of whole parts, from rows in the order of parts."""
    kept: list[np.ndarray] = []
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            # a call without a site never returns; rows of a kind that has no site need none
            kept.append(np.stack([batch.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("part", "kind", "site_id", "src", "dst")] + [batch.column("site_id").is_valid().to_numpy(zero_copy_only=False).astype(np.int64)]))
        if kept and (batch is None or sum(k.shape[1] for k in kept) >= 100_000):
            rows = np.concatenate(kept, axis=1)
            whole = rows.shape[1] if batch is None else int(np.searchsorted(rows[0], rows[0, -1]))
            kept = [rows[:, whole:]]
            for roots, nodes in _pairs_of_parts(rows[:, :whole]):
                for at in range(0, len(roots), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], pa.int64()) for x in (roots, nodes)], names=["root", "node"])


def _pairs_of_parts(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of pairs from rows (part, kind, site_id, src, dst, has a site) in the order of parts. Parts of up to 64 nodes in which no call returns anywhere but to its caller need no steps over sites: their sets of nodes are bits, and all parts are solved together. The others are solved one by one."""
    if not rows.shape[1]:
        return
    part, kind, site, src, dst, sited = rows
    first = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
    of_row = np.repeat(np.arange(len(first)), np.diff(first, append=len(part)))
    ends, ends_part = np.concatenate([src, dst]), np.concatenate([of_row, of_row])
    nodes, at, inverse = np.unique(ends, return_index=True, return_inverse=True)
    node_part = ends_part[at]
    order = np.argsort(node_part, kind="stable")
    size = np.bincount(node_part, minlength=len(first))
    start = np.cumsum(size) - size
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes)) - start[node_part[order]]
    bit = np.uint64(1) << place.astype(np.uint64) % np.uint64(64)
    # sites of an entry whose callers and returns aren't all one node
    hop = np.flatnonzero((kind == _RETURN) & (sited == 1) | (kind == _CALL) & (sited == 1))
    entry, outer = np.where(kind == _CALL, dst, src)[hop], np.where(kind == _CALL, src, dst)[hop]
    by = np.lexsort((entry, site[hop]))
    e, s, o = entry[by], site[hop][by], outer[by]
    differs = (e[1:] == e[:-1]) & (s[1:] == s[:-1]) & (o[1:] != o[:-1])
    plain = size <= 64
    plain[of_row[hop[by[1:][differs]]]] = False
    plain[of_row[kind == _FLOW]] = False

    a, b, flat = inverse[: len(src)], inverse[len(src) :], plain[of_row]
    reach = bit.copy()
    for step in (_CALL, _RETURN):  # what is below, then what is below all above
        i = np.flatnonzero(flat & (kind == step))
        if len(i):
            i = i[np.argsort(a[i], kind="stable")]
            starts = np.flatnonzero(np.diff(a[i], prepend=-1))
            to = a[i][starts]
            while True:
                more = np.bitwise_or.reduceat(reach[b[i]], starts) | reach[to]
                if (more == reach[to]).all():
                    break
                reach[to] = more
    seeds = np.unique(a[flat & (kind == _SEED)])
    by_place = nodes[order]
    for k in range(0, len(seeds), 20_000):
        some = seeds[k : k + 20_000]
        bits = np.unpackbits(reach[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(bits)
        yield nodes[some[i]], by_place[start[node_part[some]][i] + j]
    for p in np.flatnonzero(~plain):
        own = slice(first[p], first[p + 1] if p + 1 < len(first) else len(part))
        for seed, found in matched_pairs([(int(k), int(s) if ok else None, int(x), int(y)) for k, s, x, y, ok in rows[1:, own].T]):
            yield np.full(len(found), seed, np.int64), np.array(found, np.int64)


def matched_pairs(rows: list[tuple[int, int | None, int, int]]) -> Iterator[tuple[int, list[int]]]:
    """(seed, nodes) of rows (kind, site_id, src, dst): entries' steps are followed until no call returns over a new step; then each seed's nodes, above by steps and returns, below by steps and calls."""
    over: dict[int, set[int]] = defaultdict(set)  # steps within a call's depth
    down: dict[int, set[int]] = defaultdict(set)
    up: dict[int, set[int]] = defaultdict(set)
    callers: dict[tuple[int, int], list[int]] = defaultdict(list)  # by entry and site
    returns: dict[int, list[tuple[int, int]]] = defaultdict(list)
    seeds = set()
    for kind, site, src, dst in rows:
        if kind == _SEED:
            seeds.add(src)
        elif kind == _FLOW:
            over[src].add(dst)
        elif kind == _CALL:
            down[src].add(dst)
            callers[dst, site].append(src)
        else:
            up[src].add(dst)
            if site is not None:
                returns[src].append((site, dst))
    entries = {entry for entry, _ in callers}
    within = {e: {e} for e in entries}
    holders = defaultdict(list, {e: [e] for e in entries})  # entries that reach a node
    work = [(e, e) for e in entries]

    def go(entry: int, node: int) -> None:
        if node not in within[entry]:
            within[entry].add(node)
            holders[node].append(entry)
            work.append((entry, node))

    while work:
        entry, node = work.pop()
        for to in list(over.get(node, ())):
            go(entry, to)
        for site, to in returns.get(node, ()):
            for caller in callers.get((entry, site), ()):
                if to != caller and to not in over[caller]:
                    over[caller].add(to)
                    for e in list(holders[caller]):
                        go(e, to)

    known: dict[int, frozenset[int]] = {}

    def below(node: int) -> frozenset[int]:
        if node not in known:
            known[node] = frozenset(_reached(node, over, down))
        return known[node]

    lists: dict[frozenset[int], list[int]] = {}
    for seed in seeds:
        found = frozenset().union(*map(below, _reached(seed, over, up)))
        yield seed, lists.setdefault(found, list(found))


def _reached(node: int, *steps: dict[int, set[int]]) -> set[int]:
    seen, work = {node}, [node]
    while work:
        at = work.pop()
        for step in steps:
            if new := step.get(at, seen) - seen:
                seen |= new
                work += new
    return seen


def _matched_by_rounds(calls: DataFrame, flows: DataFrame, seeds: DataFrame) -> DataFrame:
    """matched_reachable for parts of any size, a frontier at a time."""
    down, up = calls.filter("NOT is_return").select("site_id", "src", "dst"), calls.filter("is_return").select("site_id", "src", "dst")
    entries = down.select(F.col("dst").alias("root"), F.col("dst").alias("node")).distinct()
    same = flows.select("src", "dst").distinct()
    while True:
        within = closure(same, entries).select("root", "node")
        over = down.toDF("site_id", "src", "root").join(within, "root").join(up.toDF("site_id", "node", "dst"), ["site_id", "node"])
        new = cut(over.select("src", "dst").filter("src <> dst").distinct().join(same, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            break
        same = cut(same.unionByName(new))
    risen = closure(same.unionByName(up.select("src", "dst")), seeds.select("root", F.col("root").alias("node")))
    return closure(same.unionByName(down.select("src", "dst")), risen.select("root", "node")).select("root", "node")


def backward_slice(edges: DataFrame, symbols: DataFrame, of: DataFrame, depth: int) -> DataFrame:
    """(root, node, dist): callers and enclosing symbols within depth steps, by least distance."""
    up = edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst")).unionByName(symbols.filter("parent_sym IS NOT NULL").select(F.col("sym_id").alias("src"), F.col("parent_sym").alias("dst")))
    return closure(up, of.select("root", F.col("root").alias("node")), depth)


def forward_slice(edges: DataFrame, of: DataFrame, depth: int) -> DataFrame:
    return closure(as_edges(edges), of.select("root", F.col("root").alias("node")), depth)


def impact_set(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(root, node, dist): all callers, direct or not, with the symbol itself."""
    return closure(reversed_edges(as_edges(edges)), of.select("root", F.col("root").alias("node")))


def lifelines(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(site_id, caller_class, callee_class)"""
    owner = symbols.select("sym_id", "parent_sym")
    a, b = owner.toDF("caller", "caller_class"), owner.toDF("callee", "callee_class")
    return edges.join(a, "caller").join(b, "callee").select("site_id", "caller_class", "callee_class")


def message_order(messages: DataFrame, sequence: str, *order: str) -> DataFrame:
    """Adds ordinal from 0 within each sequence."""
    return messages.withColumn("ordinal", (F.row_number().over(Window.partitionBy(sequence).orderBy(*order)) - 1).cast("long"))


def bad_calls(sites: DataFrame, methods: DataFrame, components: DataFrame) -> DataFrame:
    """(fault, n): sites (site_id, token) without a token, and methods (sym_id) that the components (node) hold not at all or more than once. Should be none."""
    loose = sites.filter("token IS NULL").select(F.lit("site without a token").alias("fault"))
    held = components.groupBy(F.col("node").alias("sym_id")).agg(F.count("*").alias("held"))
    uneven = methods.select("sym_id").distinct().join(held, "sym_id", "left").filter("held IS NULL OR held <> 1").select(F.lit("method not in one component").alias("fault"))
    return loose.unionByName(uneven).groupBy("fault").agg(F.count("*").alias("n"))
