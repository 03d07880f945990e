"""Graph algorithms against plain definitions on random graphs."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators import bdd, flow

graphs = st.integers(1, 7).flatmap(lambda n: st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=14, unique=True).map(lambda es: {b: sorted({d for s, d in es if s == b}) for b in range(n)}))


def reached(succ, gone=None):
    seen, work = set(), [0] if gone != 0 else []
    while work:
        b = work.pop()
        if b not in seen and b != gone:
            seen.add(b)
            work += succ[b]
    return seen


def dominators(succ):
    all_ = reached(succ)
    return {b: {d for d in all_ if d == b or b not in reached(succ, d)} for b in all_}


@settings(max_examples=200, deadline=None)
@given(graphs)
def test_idom_is_the_nearest_strict_dominator(succ):
    dom = dominators(succ)
    idom = flow.immediate_dominators(succ)
    assert set(idom) == set(dom)
    for b in dom:
        strict = dom[b] - {b}
        assert idom[b] == (max(strict, key=lambda d: len(dom[d])) if strict else b)


@settings(max_examples=200, deadline=None)
@given(graphs)
def test_frontier_by_definition(succ):
    dom = dominators(succ)
    got = flow.frontiers(succ, flow.immediate_dominators(succ))
    for x in dom:
        want = {y for p in dom for y in succ[p] if x in dom[p] and not (x in dom[y] and x != y)}
        assert got.get(x, set()) == want


@settings(max_examples=100, deadline=None)
@given(graphs)
def test_models_by_enumeration(succ):
    edges = [(a, b) for a, bs in succ.items() for b in bs]
    if len(edges) > 9:
        return
    for order in (None, bdd.force_order(edges), bdd.discovery_order(succ, edges)):
        d, f, n = bdd.path_formula(list(succ), edges, order)
        want = 0
        for taken in itertools.product((0, 1), repeat=len(edges)):
            ok = True
            for b in succ:
                out = [t for t, (s, _) in zip(taken, edges, strict=True) if s == b]
                reach = b == 0 or any(t for t, (_, e) in zip(taken, edges, strict=True) if e == b)
                ok &= not reach or not out or sum(out) == 1
            want += ok
        assert d.count(f, n) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ox^-"), st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=8))
def test_connectives_and_canonicity(steps):
    d = bdd.Bdd()
    f, table = bdd.TRUE, [True] * 32
    bit = lambda row, v: bool(row >> v & 1)
    for op, a, b in steps:
        g = d.both(d.var(a), d.negate(d.var(b)))
        gt = [bit(r, a) and not bit(r, b) for r in range(32)]
        f, table = {"o": (d.either(f, g), [x or y for x, y in zip(table, gt, strict=True)]), "x": (d.both(f, g), [x and y for x, y in zip(table, gt, strict=True)]), "^": (d.differ(f, g), [x != y for x, y in zip(table, gt, strict=True)]), "-": (d.restrict(f, a, 1), [table[r | 1 << a] for r in range(32)])}[op]
    assert d.count(f, 5) == sum(table)
    assert all(low != high for _, low, high in d.nodes[2:]) and len(set(d.nodes[2:])) == len(d.nodes) - 2


def test_diamond():
    succ = {0: [1, 2], 1: [3], 2: [3], 3: []}
    assert flow.immediate_dominators(succ) == {0: 0, 1: 0, 2: 0, 3: 0}
    assert dict(flow.frontiers(succ, flow.immediate_dominators(succ))) == {1: {3}, 2: {3}}
    assert flow.acyclic_paths(succ) == 2 and flow.longest_path(succ) == 3


def test_ssa_of_a_loop():
    succ = {0: [1], 1: [2, 3], 2: [1], 3: []}
    stmts = {0: [(10, [], ["i"])], 1: [(11, ["i"], [])], 2: [(12, ["i"], ["i"])], 3: [(13, ["i"], [])]}
    defs, phis, uses = flow.to_ssa(succ, stmts)
    assert [(p[1], p[2]) for p in phis] == [(1, "i")] and len(defs) == 3
    phi = phis[0][0]
    assert {u for u, s in uses if s in (11, 12, 13)} == {phi}
    assert sorted(p for p, _ in phis[0][3]) == [0, 2]
    assert len({d[0] for d in defs}) == len(defs)


@settings(max_examples=200, deadline=None)
@given(graphs)
def test_reverse_postorder_and_path_counts(succ):
    order = flow.reverse_postorder(succ)
    assert order[0] == 0 and sorted(order) == sorted(reached(succ))
    ahead = {b: [s for s in ss if s > b] for b, ss in succ.items()}  # no cycles: every edge goes on in the order
    place = {b: i for i, b in enumerate(flow.reverse_postorder(ahead))}
    assert all(place[b] < place[s] for b in place for s in ahead[b])
    ways, work = [], [[0]]
    while work:
        path = work.pop()
        on = ahead[path[-1]]
        work += [[*path, s] for s in on]
        ways += [] if on else [path]
    assert flow.acyclic_paths(ahead) == len(ways) and flow.longest_path(ahead) == max(map(len, ways))


def test_a_long_function_has_a_formula():
    n = 3000
    succ = {b: [b + 1] for b in range(n)} | {n: []}
    d, f, variables = bdd.path_formula(list(succ), [(b, b + 1) for b in range(n)])
    assert d.count(f, variables) == 1 and d.size(d.restrict(f, n, 1)) > 1


def test_many_ways_out_are_exclusive():
    edges = [(0, b) for b in range(1, 40)]
    d, f, n = bdd.path_formula(list(range(40)), edges)
    assert d.count(f, n) == 39
