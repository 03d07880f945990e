"""The control-flow graph of one callable, from its rows of the syntax tree.

Edges are Uncond, True, False, LoopBack, Switch, Except and Return. Blocks that the
entry doesn't reach are left out and the rest numbered in reverse postorder, the
entry being 0; every function has one exit block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from graphloom.operators.flow import reverse_postorder


@dataclass
class Frame:
    label: str | None
    break_to: int
    continue_to: int | None


@dataclass
class Builder:
    rows: list[dict]
    kids: dict[int, list[int]]
    stmts: dict[int, list[int]] = field(default_factory=dict)
    edges: list[tuple[int, int, str]] = field(default_factory=list)
    frames: list[Frame] = field(default_factory=list)
    handlers: list[tuple[list[int], int | None]] = field(default_factory=list)

    def block(self) -> int:
        self.stmts[len(self.stmts)] = []
        return len(self.stmts) - 1

    def edge(self, a: int, b: int, kind: str) -> None:
        if (a, b, kind) not in self.edges:
            self.edges.append((a, b, kind))

    def build(self, body: int | None) -> None:
        entry = self.block()
        self.exit = self.block()
        last = self.statement(body, entry) if body is not None else entry
        if last is not None:
            self.edge(last, self.exit, "Uncond")

    def many(self, ids: list[int], at: int | None) -> int | None:
        for i in ids:
            if at is None:  # behind a jump: kept apart, pruned later unless a label leads there
                at = self.block()
            at = self.statement(i, at)
        return at

    def statement(self, i: int, at: int, label: str | None = None) -> int | None:
        """Adds a statement at the end of a block; the block that follows it, or None behind a jump."""
        row, kids = self.rows[i], self.kids.get(i, [])
        how = getattr(self, "_" + row["node_type"].lower(), None)
        if how is None:
            self.stmts[at].append(i)
            return at
        return how(i, row, kids, at, label)

    def _block(self, i, row, kids, at, label):
        return self.many(kids, at)

    def _synchronized(self, i, row, kids, at, label):
        self.stmts[at].append(kids[0])
        return self.many(kids[1:], at)

    def _labeled_stmt(self, i, row, kids, at, label):
        after = self.block()
        self.frames.append(Frame(row["text"], after, None))
        end = self.statement(kids[0], at, row["text"]) if kids else at
        self.frames.pop()
        if end is not None:
            self.edge(end, after, "Uncond")
        return after

    def _if_stmt(self, i, row, kids, at, label):
        self.stmts[at].append(kids[0])
        join, then = self.block(), self.block()
        self.edge(at, then, "True")
        ends = [self.statement(kids[1], then)] if len(kids) > 1 else [then]
        if len(kids) > 2:
            other = self.block()
            self.edge(at, other, "False")
            ends.append(self.statement(kids[2], other))
        else:
            self.edge(at, join, "False")
        for e in ends:
            if e is not None:
                self.edge(e, join, "Uncond")
        return join if len(kids) < 3 or any(e is not None for e in ends) else None

    def _loop(self, head: int, body: int | None, update: list[int], label, test: list[int]) -> int:
        after, inside = self.block(), self.block()
        self.stmts[head] += test
        self.edge(head, inside, "True")
        self.edge(head, after, "False")
        again = head
        if update:
            again = self.block()
            self.stmts[again] += update
        self.frames.append(Frame(label, after, again))
        end = self.statement(body, inside) if body is not None else inside
        self.frames.pop()
        if end is not None:
            self.edge(end, again, "Uncond" if update else "LoopBack")
        if update:
            self.edge(again, head, "LoopBack")
        return after

    def _while_stmt(self, i, row, kids, at, label):
        head = self.block()
        self.edge(at, head, "Uncond")
        return self._loop(head, kids[1] if len(kids) > 1 else None, [], label, kids[:1])

    def _for_stmt(self, i, row, kids, at, label):
        parts = {self.rows[k]["text"]: self.kids.get(k, []) for k in kids if self.rows[k]["node_type"] == "FOR_PART"}
        body = next((k for k in kids if self.rows[k]["node_type"] != "FOR_PART"), None)
        self.stmts[at] += parts.get("init", [])
        head = self.block()
        self.edge(at, head, "Uncond")
        return self._loop(head, body, parts.get("update", []), label, parts.get("cond", []))

    def _enhanced_for(self, i, row, kids, at, label):
        self.stmts[at] += kids[1:2]
        head = self.block()
        self.edge(at, head, "Uncond")
        return self._loop(head, kids[2] if len(kids) > 2 else None, [], label, kids[:1])

    def _do_while_stmt(self, i, row, kids, at, label):
        body, test, after = self.block(), self.block(), self.block()
        self.edge(at, body, "Uncond")
        self.frames.append(Frame(label, after, test))
        end = self.statement(kids[0], body) if kids else body
        self.frames.pop()
        if end is not None:
            self.edge(end, test, "Uncond")
        self.stmts[test] += kids[1:]
        self.edge(test, body, "LoopBack")
        self.edge(test, after, "False")
        return after

    def _switch_stmt(self, i, row, kids, at, label):
        self.stmts[at] += kids[:1]
        after = self.block()
        self.frames.append(Frame(label, after, None))
        fall, default = None, False
        for k in kids[1:]:
            one = self.block()
            self.edge(at, one, "Switch")
            if fall is not None:
                self.edge(fall, one, "Uncond")
            default = default or self.rows[k]["text"] == "default"
            fall = self.many(self.kids.get(k, []), one)
            if self.rows[k]["op"] == "->" and fall is not None:
                self.edge(fall, after, "Uncond")
                fall = None
        self.frames.pop()
        if fall is not None:
            self.edge(fall, after, "Uncond")
        if not default:
            self.edge(at, after, "False")
        return after

    def _try_stmt(self, i, row, kids, at, label):
        kind = lambda k: self.rows[k]["node_type"]
        catches = [k for k in kids if kind(k) == "CATCH_CLAUSE"]
        final = next((k for k in kids if kind(k) == "FINALLY_CLAUSE"), None)
        rest = [k for k in kids if kind(k) not in ("CATCH_CLAUSE", "FINALLY_CLAUSE")]
        after, body = self.block(), self.block()
        starts = [self.block() for _ in catches]
        last = self.block() if final is not None else None
        self.edge(at, body, "Uncond")
        self.handlers.append((starts, last))
        end = self.many(rest, body)
        self.handlers.pop()
        ends = [end]
        for s in starts:
            self.edge(body, s, "Except")
        if not starts and last is not None:
            self.edge(body, last, "Except")
        for k, s in zip(catches, starts, strict=True):
            if last is not None:
                self.handlers.append(([], last))
            ends.append(self.many(self.kids.get(k, []), s))
            if last is not None:
                self.handlers.pop()
        for e in ends:
            if e is not None:
                self.edge(e, last if last is not None else after, "Uncond")
        if last is not None:
            end = self.many(self.kids.get(final, []), last)
            if end is not None:
                self.edge(end, after, "Uncond")
        return after

    def _throw_stmt(self, i, row, kids, at, label):
        self.stmts[at].append(i)
        for starts, last in reversed(self.handlers):
            if starts or last is not None:
                self.edge(at, starts[0] if starts else last, "Except")
                return None
        self.edge(at, self.exit, "Except")
        return None

    def _return_stmt(self, i, row, kids, at, label):
        self.stmts[at].append(i)
        self.edge(at, self.exit, "Return")
        return None

    def _jump(self, i, row, at, loops_only):
        self.stmts[at].append(i)
        for f in reversed(self.frames):
            if row["text"]:
                if f.label == row["text"] and (not loops_only or f.continue_to is not None):
                    return f
            elif (f.continue_to is not None) if loops_only else (f.label is None or f.continue_to is not None):
                return f
        return None

    def _break_stmt(self, i, row, kids, at, label):
        f = self._jump(i, row, at, False)
        self.edge(at, f.break_to if f else self.exit, "Uncond")
        return None

    def _continue_stmt(self, i, row, kids, at, label):
        f = self._jump(i, row, at, True)
        self.edge(at, f.continue_to if f else self.exit, "LoopBack")
        return None


def build(rows: list[dict], fn: int) -> tuple[list[tuple[int, list[int], bool, bool]], list[tuple[int, int, str]]]:
    """Blocks (id, statements by pre, is_entry, is_exit) and edges of the callable at row fn."""
    kids: dict[int, list[int]] = {}
    for r in rows[fn + 1 : fn + rows[fn]["size"]]:
        kids.setdefault(r["parent"], []).append(r["pre"])
    b = Builder(rows, kids)
    b.build(next((k for k in kids.get(fn, []) if rows[k]["node_type"] == "BLOCK"), None))
    succ = {k: [] for k in b.stmts}
    for s, d, _ in b.edges:
        succ[s].append(d)
    order = reverse_postorder(succ)
    if b.exit not in order:  # no way to the exit, as in an endless loop: it stays, alone
        order.append(b.exit)
    number = {old: new for new, old in enumerate(order)}
    blocks = [(number[k], b.stmts[k], number[k] == 0, k == b.exit) for k in order]
    return blocks, [(number[s], number[d], t) for s, d, t in b.edges if s in number and d in number]


def uses_and_defs(rows: list[dict], kids: dict[int, list[int]], i: int) -> tuple[list[str], list[str]]:
    """Variables that a statement reads and sets; nested statements and lambdas count as read."""
    uses: list[str] = []
    defs: list[str] = []

    def walk(k: int) -> None:
        r, below = rows[k], kids.get(k, [])
        if r["node_type"] == "IDENTIFIER_EXPR":
            uses.append(r["text"])
        elif r["node_type"] in ("LOCAL_VAR_DECL", "PARAM_DECL") and r["text"]:
            for c in below:
                walk(c)
            defs.append(r["text"])
        elif r["node_type"] == "ASSIGN_EXPR" and below and rows[below[0]]["node_type"] == "IDENTIFIER_EXPR":
            if r["op"] != "=":
                uses.append(rows[below[0]]["text"])
            for c in below[1:]:
                walk(c)
            defs.append(rows[below[0]]["text"])
        elif r["node_type"] == "UNARY_EXPR" and r["op"] in ("++", "--") and below and rows[below[0]]["node_type"] == "IDENTIFIER_EXPR":
            uses.append(rows[below[0]]["text"])
            defs.append(rows[below[0]]["text"])
        elif r["node_type"] == "CALL_EXPR" and below and rows[below[0]]["node_type"] == "IDENTIFIER_EXPR" and rows[below[0]]["text"] == r["text"]:
            for c in below[1:]:
                walk(c)
        else:
            for c in below:
                walk(c)

    walk(i)
    return list(dict.fromkeys(uses)), list(dict.fromkeys(defs))
