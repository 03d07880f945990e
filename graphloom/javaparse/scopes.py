"""What a file alone tells of its calls: whose type a receiver has, and what variables are given."""

from __future__ import annotations

from collections.abc import Iterator

_TYPES = ("CLASS_DECL", "INTERFACE_DECL", "ENUM_DECL", "RECORD_DECL", "ANNOTATION_DECL")
_CALLABLES = ("METHOD_DECL", "CONSTRUCTOR_DECL")
_VARIABLES = ("LOCAL_VAR_DECL", "PARAM_DECL", "FIELD_DECL")


class Scopes:
    """Declarations of one flattened tree by what encloses them."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.kids: dict[int, list[int]] = {}
        for r in rows:
            self.kids.setdefault(r["parent"], []).append(r["pre"])
        self.owner: list[int | None] = [None] * len(rows)  # nearest type around a node
        self.inside: list[int | None] = [None] * len(rows)  # nearest callable around a node
        self.declared: dict[tuple[int | None, str], list[int]] = {}  # variables of a callable or type by name, in order
        for r in rows:
            up = r["parent"]
            if up is not None and up >= 0:
                above = rows[up]["node_type"]
                self.owner[r["pre"]] = up if above in _TYPES else self.owner[up]
                self.inside[r["pre"]] = up if above in _CALLABLES else None if above in _TYPES else self.inside[up]
            if r["node_type"] in _VARIABLES and r["text"]:
                home = self.inside[r["pre"]] if r["node_type"] != "FIELD_DECL" else self.owner[r["pre"]]
                self.declared.setdefault((home, r["text"]), []).append(r["pre"])

    def type_of(self, declaration: int) -> str | None:
        return next((self.rows[k]["text"] for k in self.kids.get(declaration, []) if self.rows[k]["node_type"] == "TYPE_REF" and self.rows[k]["op"] is None), None)

    def variable(self, name: str, at: int) -> int | None:
        """The declaration that a name means at a node: of the callable around it, the latest before it, else a field of the types around."""
        before = [d for d in self.declared.get((self.inside[at], name), ()) if d < at] if self.inside[at] is not None else []
        if before:
            return before[-1]
        home = self.owner[at]
        while home is not None:
            if (home, name) in self.declared:
                return self.declared[home, name][0]
            home = self.owner[home]
        return None

    def receiver(self, call: int) -> tuple[str, str | None, str | None]:
        """(how, type name, variable): how is own (the type around it), super, static, variable, new or unknown."""
        row, below = self.rows[call], self.kids.get(call, [])
        if row["node_type"] == "NEW_EXPR":
            return "new", self.type_of(call) or row["text"], None
        first = self.rows[below[0]] if below else None
        if first is None or first["node_type"] == "THIS_EXPR" or (first["node_type"] == "IDENTIFIER_EXPR" and first["text"] == row["text"]):
            return "own", None, None
        if first["node_type"] == "SUPER_EXPR":
            return "super", None, None
        if first["node_type"] == "NEW_EXPR":
            return "new", self.type_of(first["pre"]) or first["text"], None
        if first["node_type"] == "IDENTIFIER_EXPR":
            found = self.variable(first["text"], call)
            if found is not None:
                return "variable", self.type_of(found), first["text"]
            return ("static", first["text"], None) if first["text"][:1].isupper() else ("unknown", None, None)
        if first["node_type"] == "FIELD_ACCESS" and (inner := self.kids.get(first["pre"])) and self.rows[inner[0]]["node_type"] == "THIS_EXPR":
            home = self.owner[call]
            if (home, first["text"]) in self.declared:
                return "variable", self.type_of(self.declared[home, first["text"]][0]), first["text"]
        return "unknown", None, None

    def calls(self) -> Iterator[tuple[int, int | None, int | None, str, str | None, str | None]]:
        """(call, callable around it, type around it, how, type name, variable)"""
        for r in self.rows:
            if r["node_type"] in ("CALL_EXPR", "NEW_EXPR"):
                yield (r["pre"], self.inside[r["pre"]], self.owner[r["pre"]], *self.receiver(r["pre"]))

    def given(self) -> Iterator[tuple[int, str, str | None, str | None]]:
        """(callable, variable, type name, other): variables given a new object of a type, or another variable."""
        for r in self.rows:
            fn = self.inside[r["pre"]]
            if fn is None or r["node_type"] not in ("LOCAL_VAR_DECL", "ASSIGN_EXPR"):
                continue
            below = self.kids.get(r["pre"], [])
            if r["node_type"] == "LOCAL_VAR_DECL":
                name, values = r["text"], [k for k in below if self.rows[k]["node_type"] != "TYPE_REF"]
            elif len(below) == 2 and self.rows[below[0]]["node_type"] == "IDENTIFIER_EXPR":
                name, values = self.rows[below[0]]["text"], below[1:]
            else:
                continue
            for k in values:
                if self.rows[k]["node_type"] == "NEW_EXPR":
                    yield fn, name, self.type_of(k) or self.rows[k]["text"], None
                elif self.rows[k]["node_type"] == "IDENTIFIER_EXPR":
                    yield fn, name, None, self.rows[k]["text"]
