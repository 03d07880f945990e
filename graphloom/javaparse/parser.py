"""A tolerant recursive reader of Java: declarations, statements, calls, creations, assignments, literals.

Type arguments and annotations are read over structurally. What can't be read up to
the next statement end becomes an UNKNOWN node; no input makes it fail.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<Word>[A-Za-z_$][\w$]*)|(?P<Whitespace>[^\S\n]+)|(?P<Newline>\n)|(?P<CommentDoc>/\*\*(?!/).*?\*/)|(?P<CommentBlock>/\*.*?\*/)|(?P<CommentLine>//[^\n]*)|(?P<StringLiteral>\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*")|(?P<CharLiteral>'(?:\\.|[^'\\\n])+')
    |(?P<FloatLiteral>\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdD]?|\d[\d_]*(?:[eE][+-]?\d+)[fFdD]?|\d[\d_]*[fFdD])|(?P<IntegerLiteral>0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|\d[\d_]*[lL]?)
    |(?P<Operator>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[+\-*/%<>=!&|^~?:;,.()\[\]{}@])|(?P<Unknown>.)""",
    re.VERBOSE | re.DOTALL,
)
KEYWORDS = frozenset("if else for while do switch case break continue return throw try catch finally new instanceof class interface enum record extends implements throws import public private protected static final abstract native synchronized volatile transient strictfp default void boolean byte char short int long float double this super package assert yield".split())
_PUNCTUATION = frozenset("; , . ( ) [ ] { } ... :: ->".split())
_WORDS = {k: "Keyword" for k in KEYWORDS} | {"true": "BooleanLiteral", "false": "BooleanLiteral", "null": "NullLiteral", "var": "JavaVarKeyword"}
_SIGNS = {p: "Punctuation" for p in _PUNCTUATION} | {"@": "JavaAnnotationMarker"}
_TRIVIA = frozenset("CommentDoc CommentBlock CommentLine Newline Whitespace".split())
_MODIFIERS = frozenset("public private protected static final abstract native synchronized volatile transient strictfp default sealed".split())
_STATEMENTS = {"if": "_if", "while": "_while", "do": "_do", "for": "_for", "switch": "_switch", "try": "_try", "synchronized": "_sync"}
_PRIMITIVES = frozenset("boolean byte char short int long float double void".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_BINARY = [{"||"}, {"&&"}, {"|"}, {"^"}, {"&"}, {"==", "!="}, {"<", ">", "<=", ">=", "instanceof"}, {"<<", ">>", ">>>"}, {"+", "-"}, {"*", "/", "%"}]
_LEVEL = {op: level for level, ops in enumerate(_BINARY) for op in ops}


@dataclass(slots=True)
class Token:
    text: str
    kind: str
    line: int
    col: int


@dataclass(slots=True)
class Node:
    kind: str
    first: int
    last: int = -1
    text: str = ""
    op: str = ""
    modifiers: tuple[str, ...] = ()
    children: list[Node] = field(default_factory=list)


def tokenize(source: str, trivia: bool = False) -> list[Token]:
    out, line, start = [], 1, 0
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "Whitespace":
            if trivia:
                out.append(Token(text, kind, line, m.start() - start))
            continue
        if kind == "Word":
            out.append(Token(text, _WORDS.get(text, "Identifier"), line, m.start() - start))
            continue
        if kind == "Operator":
            out.append(Token(text, _SIGNS.get(text, "Operator"), line, m.start() - start))
            continue
        if trivia or kind not in _TRIVIA:
            out.append(Token(text, kind, line, m.start() - start))
        if "\n" in text:
            line, start = line + text.count("\n"), m.start() + text.rfind("\n") + 1
    return out


class Parser:
    def __init__(self, tokens: list[Token]):
        self.t, self.i = tokens, 0
        self.words = [t.text for t in tokens]

    # reading

    def peek(self, k: int = 0) -> str:
        try:
            return self.words[self.i + k]
        except IndexError:
            return ""

    def kind(self, k: int = 0) -> str:
        try:
            return self.t[self.i + k].kind
        except IndexError:
            return ""

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def node(self, kind: str, **more) -> Node:
        return Node(kind, self.i, **more)

    def close(self, node: Node) -> Node:
        node.last = max(node.first, min(self.i, len(self.t)) - 1)
        return node

    def skip(self, left: str, right: str) -> None:
        depth = 0
        while self.i < len(self.t):
            if self.peek() == left:
                depth += 1
            elif self.peek() == right:
                depth -= 1
            elif right == ">" and self.peek() in (">>", ">>>"):
                depth -= len(self.peek())
            elif right == ">" and self.peek() in (";", "{", "}"):
                return
            self.i += 1
            if depth <= 0:
                return

    # declarations

    def module(self) -> Node:
        node = self.node("MODULE")
        while self.i < len(self.t):
            at = self.i
            if self.peek() in ("package", "import"):
                one = self.node("PACKAGE_DECL" if self.peek() == "package" else "IMPORT_DECL")
                self.i += 1
                static = self.take("static")
                words = []
                while self.i < len(self.t) and self.peek() != ";":
                    words.append(self.peek())
                    self.i += 1
                one.text, one.modifiers = "".join(words), ("static",) if static else ()
                self.take(";")
                node.children.append(self.close(one))
            elif (d := self.declaration(None)) is not None:
                node.children.append(d)
            if self.i == at:
                self.i += 1
        return self.close(node)

    def modifiers(self, into: list[Node]) -> tuple[str, ...]:
        out = []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                use = self.node("ANNOTATION_USE")
                self.i += 1
                use.text = self.peek()
                self.i += 1
                while self.peek() == "." and self.kind(1) == "Identifier":
                    self.i += 2
                if self.peek() == "(":
                    self.skip("(", ")")
                into.append(self.close(use))
            elif self.peek() in _MODIFIERS or (self.peek() == "non" and self.peek(1) == "-"):
                out.append(self.peek())
                self.i += 1 if self.peek() != "non" else 3
            else:
                return tuple(out)

    def declaration(self, owner: str | None) -> Node | None:
        start, notes = self.i, []
        mods = self.modifiers(notes)
        word = self.peek()
        kind = {"class": "CLASS_DECL", "interface": "INTERFACE_DECL", "enum": "ENUM_DECL"}.get(word)
        if word == "@" and self.peek(1) == "interface":
            kind = "ANNOTATION_DECL"
            self.i += 1
        elif word == "record" and self.kind(1) == "Identifier" and self.peek(2) in ("(", "<"):
            kind = "RECORD_DECL"
        if kind:
            return self.type_declaration(kind, start, mods, notes)
        if owner is None:
            return None
        if word == "{":
            node = Node("STATIC_INIT" if "static" in mods else "INSTANCE_INIT", start, modifiers=mods)
            node.children = [self.block()]
            return self.close(node)
        generic = None
        if word == "<":
            generic = self.node("TYPE_PARAM")
            self.skip("<", ">")
            self.close(generic)
        more = [*notes, *([generic] if generic else [])]
        if self.kind() == "Identifier" and self.peek(1) == "(" and self.peek() == owner:
            return self.callable("CONSTRUCTOR_DECL", start, mods, more)
        if self.kind() == "Identifier" and self.peek(1) == "{" and self.peek() == owner:  # compact constructor of a record
            node = Node("CONSTRUCTOR_DECL", start, text=self.peek(), modifiers=mods, children=more)
            self.i += 1
            node.children.append(self.block())
            return self.close(node)
        at = self.i
        of = self.type_ref()
        if of is None or self.kind() not in ("Identifier",):
            self.i = at
            return None
        if self.peek(1) == "(":
            return self.callable("METHOD_DECL", start, mods, [*more, of])
        return self.fields("FIELD_DECL", start, mods, more, of)

    def fields(self, kind: str, start: int, mods, more: list[Node], of: Node) -> Node:
        """One node for each declarator would lose the shared type; the first declarator names the node, others are its siblings as children of the same kind."""
        node = Node(kind, start, text=self.peek(), modifiers=mods, children=[*more, of])
        self.i += 1
        self.dims()
        if self.take("="):
            node.children.append(self.initializer())
        while self.take(","):
            other = Node(kind, self.i, text=self.peek(), modifiers=mods, children=[Node("TYPE_REF", of.first, of.last, of.text)])
            self.i += 1
            self.dims()
            if self.take("="):
                other.children.append(self.initializer())
            node.children.append(self.close(other))
        self.take(";")
        return self.close(node)

    def dims(self) -> None:
        while self.peek() == "[" and self.peek(1) == "]":
            self.i += 2

    def initializer(self) -> Node:
        if self.peek() == "{":
            node = self.node("ARRAY_INIT")
            self.i += 1
            while self.i < len(self.t) and self.peek() != "}":
                at = self.i
                node.children.append(self.initializer())
                self.take(",")
                if self.i == at:
                    self.i += 1
            self.take("}")
            return self.close(node)
        return self.expression()

    def type_declaration(self, kind: str, start: int, mods, notes: list[Node]) -> Node:
        self.i += 1
        node = Node(kind, start, text=self.peek(), modifiers=mods, children=notes)
        self.i += 1
        if self.peek() == "<":
            one = self.node("TYPE_PARAM")
            self.skip("<", ">")
            node.children.append(self.close(one))
        if kind == "RECORD_DECL" and self.peek() == "(":
            node.children += self.params()
        while self.peek() in ("extends", "implements", "permits"):
            how = self.peek()
            self.i += 1
            while (of := self.type_ref()) is not None:
                of.op = how
                if how != "permits":
                    node.children.append(of)
                if not self.take(","):
                    break
        if self.take("{"):
            if kind == "ENUM_DECL":
                self.constants(node)
            while self.i < len(self.t) and self.peek() != "}":
                at = self.i
                if (d := self.declaration(node.text)) is not None:
                    node.children.append(d)
                elif self.i == at or self.peek() == ";":
                    self.i += 1
            self.take("}")
        return self.close(node)

    def constants(self, node: Node) -> None:
        while self.i < len(self.t) and self.peek() not in (";", "}"):
            at, notes = self.i, []
            self.modifiers(notes)
            if self.kind() == "Identifier":
                one = Node("FIELD_DECL", at, text=self.peek(), modifiers=("public", "static", "final"), children=[Node("TYPE_REF", at, at, node.text)])
                self.i += 1
                if self.peek() == "(":
                    self.skip("(", ")")
                if self.peek() == "{":
                    self.skip("{", "}")
                node.children.append(self.close(one))
            self.take(",")
            if self.i == at:
                self.i += 1
        self.take(";")

    def params(self) -> list[Node]:
        out = []
        self.take("(")
        while self.i < len(self.t) and self.peek() != ")":
            at, notes = self.i, []
            mods = self.modifiers(notes)
            of = self.type_ref()
            self.take("...")
            if of is not None and self.kind() in ("Identifier", "Keyword"):
                one = Node("PARAM_DECL", at, text=self.peek(), modifiers=mods, children=[*notes, of])
                self.i += 1
                self.dims()
                out.append(self.close(one))
            self.take(",")
            if self.i == at:
                self.i += 1
        self.take(")")
        return out

    def callable(self, kind: str, start: int, mods, more: list[Node]) -> Node:
        node = Node(kind, start, text=self.peek(), modifiers=mods, children=more)
        self.i += 1
        node.children += self.params()
        self.dims()
        if self.take("throws"):
            while self.type_ref() is not None and self.take(","):
                pass
        if self.take("default"):
            self.expression()
        if self.peek() == "{":
            node.children.append(self.block())
        else:
            self.take(";")
        return self.close(node)

    def type_ref(self) -> Node | None:
        node, notes = self.node("TYPE_REF"), []
        self.modifiers(notes)
        if self.peek() == "?":
            self.i += 1
            if self.peek() in ("extends", "super"):
                self.i += 1
                return self.type_ref()
            return self.close(node)
        if self.peek() in _PRIMITIVES or self.kind() in ("Identifier", "JavaVarKeyword"):
            node.text = self.peek()
            self.i += 1
            while self.peek() == "." and self.kind(1) == "Identifier":
                node.text += "." + self.peek(1)
                self.i += 2
            if self.peek() == "<":
                self.skip("<", ">")
            if self.peek() == "[" and self.peek(1) == "]":
                node.op = "[]"
            self.dims()
            return self.close(node)
        return None

    # statements

    def block(self) -> Node:
        node = self.node("BLOCK")
        self.take("{")
        while self.i < len(self.t) and self.peek() != "}":
            at = self.i
            node.children.append(self.statement())
            if self.i == at:
                self.i += 1
        self.take("}")
        return self.close(node)

    def condition(self) -> Node:
        self.take("(")
        e = self.expression()
        self.take(")")
        return e

    def statement(self) -> Node:
        node, word = self.node("UNKNOWN"), self.peek()
        if word == "{":
            return self.block()
        if word == ";":
            self.i += 1
            node.kind = "EXPR_STMT"
            return self.close(node)
        if self.kind() == "Identifier" and self.peek(1) == ":" and self.peek(2) != ":":
            node.kind, node.text = "LABELED_STMT", word
            self.i += 2
            node.children = [self.statement()]
            return self.close(node)
        handler = _STATEMENTS.get(word)
        if handler and not (word == "synchronized" and self.peek(1) != "("):
            self.i += 1
            getattr(self, handler)(node)
            return self.close(node)
        if word in ("return", "throw", "break", "continue", "assert") or (word == "yield" and self.peek(1) not in ("=", ".", "(")):
            node.kind = {"return": "RETURN_STMT", "throw": "THROW_STMT", "break": "BREAK_STMT", "continue": "CONTINUE_STMT", "assert": "ASSERT_STMT", "yield": "YIELD_STMT"}[word]
            self.i += 1
            if word in ("break", "continue"):
                if self.kind() == "Identifier":
                    node.text = self.peek()
                    self.i += 1
            elif self.peek() != ";":
                node.children.append(self.expression())
                if word == "assert" and self.take(":"):
                    node.children.append(self.expression())
            self.take(";")
            return self.close(node)
        if (local := self._local()) is not None:
            return local
        node.kind = "EXPR_STMT"
        node.children.append(self.expression())
        while self.i < len(self.t) and self.peek() not in (";", "}", "{"):
            self.i += 1
        self.take(";")
        return self.close(node)

    def _local(self) -> Node | None:
        start, notes = self.i, []
        mods = self.modifiers(notes)
        if self.peek() in ("class", "interface", "enum") or (self.peek() == "record" and self.kind(1) == "Identifier" and self.peek(2) == "("):
            self.i = start
            return self.declaration("")
        of = self.type_ref()
        if of is not None and self.kind() == "Identifier" and self.peek(1) in ("=", ";", ",", "[", ":"):
            return self.fields("LOCAL_VAR_DECL", start, mods, notes, of)
        self.i = start
        return None

    def _if(self, node: Node) -> None:
        node.kind = "IF_STMT"
        node.children = [self.condition(), self.statement()]
        if self.take("else"):
            node.children.append(self.statement())

    def _while(self, node: Node) -> None:
        node.kind = "WHILE_STMT"
        node.children = [self.condition(), self.statement()]

    def _do(self, node: Node) -> None:
        node.kind = "DO_WHILE_STMT"
        body = self.statement()
        self.take("while")
        node.children = [body, self.condition()]
        self.take(";")

    def _for(self, node: Node) -> None:
        self.take("(")
        at, notes = self.i, []
        mods = self.modifiers(notes)
        of = self.type_ref()
        if of is not None and self.kind() == "Identifier" and self.peek(1) == ":":
            var = Node("LOCAL_VAR_DECL", at, text=self.peek(), modifiers=mods, children=[of])
            self.i += 1
            self.close(var)
            self.i += 1
            node.kind = "ENHANCED_FOR"
            node.children = [var, self.expression()]
            self.take(")")
            node.children.append(self.statement())
            return
        self.i = at
        node.kind = "FOR_STMT"
        parts = {"init": [], "cond": [], "update": []}
        if self.peek() != ";":
            local = self._local()
            if local is not None:
                parts["init"].append(local)
            else:
                while True:
                    parts["init"].append(self.expression())
                    if not self.take(","):
                        break
                self.take(";")
        else:
            self.take(";")
        if self.peek() != ";":
            parts["cond"].append(self.expression())
        self.take(";")
        while self.i < len(self.t) and self.peek() not in (")", "{", "}"):
            at = self.i
            parts["update"].append(self.expression())
            self.take(",")
            if self.i == at:
                self.i += 1
        self.take(")")
        for name, es in parts.items():
            part = Node("FOR_PART", es[0].first if es else self.i - 1, es[-1].last if es else self.i - 1, name, children=es)
            node.children.append(part)
        node.children.append(self.statement())

    def _switch(self, node: Node) -> None:
        node.kind = "SWITCH_STMT"
        node.children = [self.condition()]
        self.take("{")
        while self.i < len(self.t) and self.peek() != "}":
            case = self.node("SWITCH_CASE")
            at = self.i
            while self.peek() in ("case", "default"):
                case.text = "default" if self.peek() == "default" else case.text or "case"
                self.i += 1
                while self.i < len(self.t) and self.peek() not in (":", "->", "}"):
                    self.i += 1
                case.op = self.peek()
                if self.peek() in (":", "->"):
                    self.i += 1
            while self.i < len(self.t) and self.peek() not in ("case", "default", "}"):
                before = self.i
                case.children.append(self.statement())
                if self.i == before:
                    self.i += 1
                if case.op == "->":
                    break
            if self.i == at:
                self.i += 1
            node.children.append(self.close(case))
        self.take("}")

    def _try(self, node: Node) -> None:
        node.kind = "TRY_STMT"
        if self.take("("):
            while self.i < len(self.t) and self.peek() != ")":
                at = self.i
                local = self._local()
                node.children.append(local if local is not None else self.expression())
                self.take(";")
                if self.i == at:
                    self.i += 1
            self.take(")")
        node.children.append(self.block())
        while self.peek() == "catch":
            one = self.node("CATCH_CLAUSE")
            self.i += 1
            if self.peek() == "(":
                at = self.i
                self.i += 1
                self.modifiers([])
                of = self.type_ref()
                while self.take("|"):
                    self.type_ref()
                if of is not None and self.kind() == "Identifier":
                    var = Node("PARAM_DECL", at + 1, text=self.peek(), children=[of])
                    self.i += 1
                    one.children.append(self.close(var))
                self.take(")")
            one.children.append(self.block())
            node.children.append(self.close(one))
        if self.peek() == "finally":
            one = self.node("FINALLY_CLAUSE")
            self.i += 1
            one.children.append(self.block())
            node.children.append(self.close(one))

    def _sync(self, node: Node) -> None:
        node.kind = "SYNCHRONIZED"
        node.children = [self.condition(), self.block()]

    # expressions

    def expression(self) -> Node:
        left = self.ternary()
        if self.peek() in _ASSIGN:
            node = Node("ASSIGN_EXPR", left.first, op=self.peek(), children=[left])
            self.i += 1
            node.children.append(self.expression())
            return self.close(node)
        return left

    def ternary(self) -> Node:
        c = self.binary(0)
        if self.peek() == "?":
            node = Node("TERNARY_EXPR", c.first, children=[c])
            self.i += 1
            node.children.append(self.expression())
            self.take(":")
            node.children.append(self.expression())
            return self.close(node)
        return c

    def operator(self) -> str:
        """Shifts come as single angle brackets, so that type arguments read well."""
        op = self.peek()
        if op == ">" and self.peek(1) == ">":
            return ">>>" if self.peek(2) == ">" else ">>"
        return "<<" if op == "<" and self.peek(1) == "<" else op

    def binary(self, level: int) -> Node:
        """Operators from a level up. Behind one of a level only those of the same or a lower one go on."""
        left, most = self.unary(), len(_BINARY)
        while level <= (at := _LEVEL.get(op := self.operator(), -1)) <= most:
            self.i += len(op) if op in ("<<", ">>", ">>>") else 1
            if op == "instanceof":
                node = Node("INSTANCEOF_EXPR", left.first, op=op, children=[left])
                if (of := self.type_ref()) is not None:
                    node.children.append(of)
                if self.kind() == "Identifier":
                    self.i += 1
            else:
                node = Node("BINARY_EXPR", left.first, op=op, children=[left, self.binary(at + 1)])
            left, most = self.close(node), at
        return left

    def unary(self) -> Node:
        if self.peek() in ("!", "~", "+", "-", "++", "--"):
            node = self.node("UNARY_EXPR", op=self.peek())
            self.i += 1
            node.children = [self.unary()]
            return self.close(node)
        if self.peek() == "(" and (cast := self._cast()) is not None:
            return cast
        return self.postfix(self.primary())

    def _cast(self) -> Node | None:
        at = self.i
        self.i += 1
        of = self.type_ref()
        while of is not None and self.take("&"):
            self.type_ref()
        if of is not None and self.take(")") and (of.text in _PRIMITIVES and self.peek() not in (")", ";") or self.kind() in ("Identifier", "StringLiteral", "CharLiteral", "IntegerLiteral", "FloatLiteral", "BooleanLiteral", "NullLiteral") or self.peek() in ("(", "!", "~", "new", "this", "super")) and self.peek() != "->":
            node = Node("CAST_EXPR", at, children=[of, self.unary()])
            return self.close(node)
        self.i = at
        return None

    def _lambda(self) -> Node | None:
        at, names = self.i, []
        if self.kind() == "Identifier" and self.peek(1) == "->":
            names, self.i = [self.peek()], self.i + 2
        elif self.peek() == "(":
            k, depth = 0, 0
            while self.i + k < len(self.t):
                depth += {"(": 1, ")": -1}.get(self.peek(k), 0)
                k += 1
                if depth == 0:
                    break
            if self.peek(k) != "->":
                return None
            names = [self.peek(j) for j in range(1, k - 1) if self.kind(j) == "Identifier" and self.peek(j + 1) in (",", ")")]
            self.i += k + 1
        else:
            return None
        node = Node("LAMBDA_EXPR", at)
        node.children = [Node("PARAM_DECL", at, at, n) for n in names]
        node.children.append(self.block() if self.peek() == "{" else self.expression())
        return self.close(node)

    def arguments(self) -> list[Node]:
        out = []
        self.take("(")
        while self.i < len(self.t) and self.peek() not in (")", ";", "}"):
            at = self.i
            out.append(self.expression())
            self.take(",")
            if self.i == at:
                self.i += 1
        self.take(")")
        return out

    def primary(self) -> Node:
        if (fn := self._lambda()) is not None:
            return fn
        node, word, kind = self.node("UNKNOWN", text=self.peek()), self.peek(), self.kind()
        if word == "(":
            self.i += 1
            inner = self.expression()
            self.take(")")
            return inner
        if word == "new":
            self.i += 1
            of = self.type_ref() or Node("TYPE_REF", self.i, self.i)
            node.kind, node.text = "NEW_EXPR", of.text
            node.children = [of]
            if self.peek() == "(":
                node.children += self.arguments()
                if self.peek() == "{":
                    body = self.node("CLASS_BODY")
                    self.i += 1
                    while self.i < len(self.t) and self.peek() != "}":
                        at = self.i
                        if (d := self.declaration("")) is not None:
                            body.children.append(d)
                        elif self.i == at:
                            self.i += 1
                    self.take("}")
                    node.children.append(self.close(body))
            else:
                node.kind = "ARRAY_CREATE"
                while self.take("["):
                    if self.peek() != "]":
                        node.children.append(self.expression())
                    self.take("]")
                if self.peek() == "{":
                    node.children.append(self.initializer())
            return self.close(node)
        if word == "switch":
            self.i += 1
            self._switch(node)
            node.kind = "SWITCH_EXPR"
            return self.close(node)
        if kind.endswith("Literal"):
            node.kind = "LITERAL"
        elif word in ("this", "super"):
            node.kind = "THIS_EXPR" if word == "this" else "SUPER_EXPR"
        elif kind == "Identifier" or word in _PRIMITIVES or kind == "JavaVarKeyword":
            node.kind = "IDENTIFIER_EXPR"
        if node.kind != "UNKNOWN" or word not in (")", "}", ";", ",", ""):
            self.i += 1
        self.close(node)
        if self.peek() == "(" and node.kind in ("IDENTIFIER_EXPR", "THIS_EXPR", "SUPER_EXPR"):
            call = Node("CALL_EXPR", node.first, text=word)
            call.children = [node, *self.arguments()]
            return self.close(call)
        return node

    def postfix(self, left: Node) -> Node:
        while True:
            if self.peek() == ".":
                self.i += 1
                if self.peek() == "<":
                    self.skip("<", ">")
                if self.peek() == "new":
                    node = Node("FIELD_ACCESS", left.first, text="new", children=[left, self.primary()])
                else:
                    name = self.peek()
                    part = Node("FIELD_ACCESS", left.first, text=name, children=[left])
                    if self.kind() in ("Identifier", "Keyword"):
                        self.i += 1
                    self.close(part)
                    if self.peek() == "(":
                        node = Node("CALL_EXPR", left.first, text=name, children=[left])
                        node.children += self.arguments()
                    else:
                        node = part
                left = self.close(node)
            elif self.peek() == "[":
                self.i += 1
                node = Node("ARRAY_ACCESS", left.first, children=[left])
                if self.peek() != "]":
                    node.children.append(self.expression())
                self.take("]")
                left = self.close(node)
            elif self.peek() in ("++", "--"):
                node = Node("UNARY_EXPR", left.first, op=self.peek(), children=[left])
                self.i += 1
                left = self.close(node)
            elif self.peek() == "::":
                self.i += 1
                node = Node("METHOD_REF", left.first, text=self.peek(), children=[left])
                self.i += 1
                left = self.close(node)
            else:
                return left


def parse(source: str) -> tuple[list[Token], Node]:
    tokens = tokenize(source)
    return tokens, Parser(tokens).module()


def flatten(root: Node) -> list[dict]:
    """Rows in preorder with parent, depth (from 1) and size."""
    out: list[dict] = []
    stack: list[tuple[Node, int | None, int]] = [(root, None, 1)]
    while stack:
        node, parent, depth = stack.pop()
        pre = len(out)
        out.append({"pre": pre, "parent": parent, "depth": depth, "size": 1, "node_type": node.kind, "op": node.op or None, "text": node.text or None, "modifiers": list(node.modifiers), "first_tok": node.first, "last_tok": node.last})
        if node.children:
            stack += [(c, pre, depth + 1) for c in reversed(node.children)]
    for row in reversed(out):
        if row["parent"] is not None:
            out[row["parent"]]["size"] += row["size"]
    return out
