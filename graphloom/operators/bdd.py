"""Reduced ordered decision diagrams, and summaries of a function's paths as one formula over its edges."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import flow

FALSE, TRUE = 0, 1
SATURATED = 2**64 - 1


class Bdd:
    """Nodes (variable, low, high), each once; 0 and 1 are the constants."""

    def __init__(self):
        self.nodes: list[tuple[int, int, int]] = [(1 << 30, 0, 0), (1 << 30, 1, 1)]
        self.unique: dict[tuple[int, int, int], int] = {}
        self.memo: dict[tuple, int] = {}

    def node(self, var: int, low: int, high: int) -> int:
        if low == high:
            return low
        key = (var, low, high)
        if (found := self.unique.get(key)) is None:
            found = self.unique[key] = len(self.nodes)
            self.nodes.append(key)
        return found

    def var(self, v: int) -> int:
        return self.node(v, FALSE, TRUE)

    def _known(self, f: int, g: int, h: int) -> int | None:
        if f == TRUE or g == h:
            return g
        if f == FALSE:
            return h
        if g == TRUE and h == FALSE:
            return f
        return self.memo.get((f, g, h))

    def ite(self, f: int, g: int, h: int) -> int:
        """If f then g else h: every connective is a case of it. What is still to do is a list, so that deep diagrams do no harm."""
        todo = [(f, g, h)]
        while todo:
            key = todo[-1]
            if self._known(*key) is None:
                v = min(self.nodes[x][0] for x in key)
                parts = [tuple(self.cofactor(x, v, b) for x in key) for b in (0, 1)]
                found = [self._known(*p) for p in parts]
                if None in found:
                    todo += [p for p, x in zip(parts, found, strict=True) if x is None]
                    continue
                self.memo[key] = self.node(v, *found)
            todo.pop()
        return self._known(f, g, h)

    def cofactor(self, f: int, v: int, value: int) -> int:
        """Of a diagram whose top variable isn't before v."""
        var, low, high = self.nodes[f]
        return f if var != v else high if value else low

    def negate(self, f: int) -> int:
        return self.ite(f, FALSE, TRUE)

    def both(self, f: int, g: int) -> int:
        return self.ite(f, g, FALSE)

    def either(self, f: int, g: int) -> int:
        return self.ite(f, TRUE, g)

    def differ(self, f: int, g: int) -> int:
        return self.ite(f, self.negate(g), g)

    def implies(self, f: int, g: int) -> int:
        return self.ite(f, g, TRUE)

    def restrict(self, f: int, v: int, value: int) -> int:
        """f with a variable fixed anywhere."""
        made: dict[int, int] = {}
        todo = [f]
        while todo:
            x = todo[-1]
            var, low, high = self.nodes[x]
            if var > v:
                made[x] = x
            elif var == v:
                made[x] = high if value else low
            elif low in made and high in made:
                made[x] = self.node(var, made[low], made[high])
            else:
                todo += [y for y in (low, high) if y not in made]
                continue
            todo.pop()
        return made[f]

    def count(self, f: int, n_vars: int) -> int:
        """Models over n_vars variables."""
        level = lambda x: min(self.nodes[x][0], n_vars)
        ways: dict[int, int] = {FALSE: 0, TRUE: 1}
        stack = [f]
        while stack:
            x = stack[-1]
            if x in ways:
                stack.pop()
                continue
            v, low, high = self.nodes[x]
            missing = [y for y in (low, high) if y not in ways]
            if missing:
                stack += missing
                continue
            ways[x] = sum(ways[y] << (level(y) - v - 1) for y in (low, high))
            stack.pop()
        return ways[f] << level(f)

    def size(self, f: int) -> int:
        seen, stack = set(), [f]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += self.nodes[x][1:] if x > 1 else ()
        return len(seen)


def force_order(edges: list[tuple[int, int]], rounds: int | None = None) -> list[int]:
    """Edges in an order that keeps those of one block together: each moves to the mean of its blocks' means, round by round."""
    n = len(edges)
    place = {e: float(i) for i, e in enumerate(range(n))}
    touching: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(edges):
        for block in (a, b):
            touching.setdefault(block, []).append(i)
    best = list(range(n))
    for _ in range(rounds or min(10 * n, 200)):
        middle = {b: sum(place[i] for i in es) / len(es) for b, es in touching.items()}
        order = sorted(range(n), key=lambda i: ((middle[edges[i][0]] + middle[edges[i][1]]) / 2, i))
        if order == best:
            break
        best, place = order, {i: float(k) for k, i in enumerate(order)}
    return best


def discovery_order(succ: flow.Graph, edges: list[tuple[int, int]]) -> list[int]:
    """Edges in the order in which a depth-first walk meets them."""
    place = {b: i for i, b in enumerate(flow.reverse_postorder(succ))}
    return sorted(range(len(edges)), key=lambda i: (place.get(edges[i][0], 1 << 30), place.get(edges[i][1], 1 << 30), i))


def path_formula(blocks: list[int], edges: list[tuple[int, int]], order: list[int] | None = None) -> tuple[Bdd, int, int]:
    """(diagrams, formula, number of variables): variable 0 is the entry, then one for each edge. If a block is reached: with one way on it is taken, with two one or the other, with more exactly one. The entry is reached."""
    bdd = Bdd()
    order = order if order is not None else list(range(len(edges)))
    var = {0: 0} | {e + 1: k + 1 for k, e in enumerate(order)}
    into: dict[int, list[int]] = {}
    ways: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(edges):
        ways.setdefault(a, []).append(i)
        into.setdefault(b, []).append(i)
    last_first = lambda es: sorted(es, key=lambda i: -var[i + 1])
    f = TRUE
    first = lambda b: min((var[i + 1] for i in ways.get(b, []) + into.get(b, [])), default=0)
    for b in sorted(blocks, key=first, reverse=True):  # from the last variables up, so that each step meets only the top of what there is
        reached = bdd.var(0) if b == 0 else FALSE
        for i in last_first(into.get(b, [])):
            reached = bdd.either(bdd.var(var[i + 1]), reached)
        one, none = FALSE, TRUE  # exactly one of the ways out, none of them: a chain from the last variable up
        for i in last_first(ways.get(b, [])):
            taken = bdd.var(var[i + 1])
            one, none = bdd.ite(taken, none, one), bdd.ite(taken, FALSE, none)
        if b in ways:
            f = bdd.both(bdd.implies(reached, one), f)
    f = bdd.both(bdd.var(0), f)
    return bdd, f, len(edges) + 1


def feasible(bdd: Bdd, f: int, conditions: list[tuple[int, int]]) -> int:
    """f with every branch's condition (condition variable, edge variable) implying its true edge; condition variables come after all edges."""
    for condition, edge in conditions:
        f = bdd.both(f, bdd.implies(bdd.var(condition), bdd.var(edge)))
    return f


def path_metrics(gathered: DataFrame) -> DataFrame:
    """(fn_sym, sat_count, n_nodes): models of the path formula (the entry's variable counted as free, as it is forced true), saturating, and the diagram's size."""

    def run(x):
        edges = [(e["src"], e["dst"]) for e in x["edges"] or []]
        bdd, f, n = path_formula(x["blocks"], edges, force_order(edges))
        yield Decimal(min(bdd.count(f, n), SATURATED)), bdd.size(f)

    return flow.over_functions(gathered, run, "sat_count decimal(20,0), n_nodes int")


def bdd_nodes(gathered: DataFrame) -> DataFrame:
    """(fn_sym, node_id, var, lo, hi) of each function's path formula; equal formulas in one order give equal tables."""

    def run(x):
        edges = [(e["src"], e["dst"]) for e in x["edges"] or []]
        bdd, f, _ = path_formula(x["blocks"], edges)
        seen, stack = set(), [f]
        while stack:
            i = stack.pop()
            if i > 1 and i not in seen:
                seen.add(i)
                yield (i, *bdd.nodes[i])
                stack += bdd.nodes[i][1:]

    return flow.over_functions(gathered, run, "node_id long, var int, lo long, hi long")


#: How often a recursive function is followed into itself.
UNWIND = 3


def unwind_depths(components: DataFrame) -> DataFrame:
    """(sym, unwind_depth): UNWIND for what is in a cycle of calls, by itself or with others (scc_class over 0), else 0."""
    return components.select(F.col("node").alias("sym"), F.when(F.col("scc_class") > 0, UNWIND).otherwise(0).cast("long").alias("unwind_depth"))
