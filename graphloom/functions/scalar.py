"""Column functions of the program graph; all but the two byte-wise hashes stay in the JVM."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by language.
LANGUAGES = {
    "Java": ["java"], "Kotlin": ["kt", "kts"], "Swift": ["swift"], "Python": ["py", "pyw", "pyx"], "JavaScript": ["js", "jsx", "mjs", "cjs"],
    "TypeScript": ["ts", "tsx", "mts", "cts"], "Rust": ["rs"], "Cpp": ["cpp", "c", "h", "hpp", "cc", "cxx", "hh", "hxx", "c++", "h++"], "Go": ["go"], "Generic": ["cs"],
}
# Extensions of source files that a server-side scan takes besides those of LANGUAGES.
OTHER_SOURCES = "rb php scala groovy lua sh bash zsh pl pm r m mm dart zig nim elm erl hrl ex exs clj cljs hs v sv vhdl asm s sql".split()
# Directories that a scan leaves out, and ends of paths of test directories.
SKIPPED_DIRS = "target node_modules build dist out vendor venv .git".split()
TEST_DIRS = "/src/test /src/androidtest /src/testdebug /src/testrelease /__tests__ /tests /test /spec /specs".split()
# Java token classes.
KEYWORDS = "if else for while do switch case break continue return throw try catch finally new instanceof class interface enum record extends implements throws import public private protected static final abstract native synchronized volatile transient strictfp default void boolean byte char short int long float double this super package assert yield".split()
OPERATORS = "+ - * / % == != < > <= >= && || ! & | ^ ++ -- ~ << >> >>> = += -= *= /= %= &= |= ^= <<= >>= >>>=".split()
PUNCTUATION = "; , . ( ) [ ] { } ... :: ->".split()
# Primitive types, collection types, standard-library stubs.
PRIMITIVES = "void boolean byte short char int long float double".split()
COLLECTIONS = "List java.util.List Set java.util.Set Map java.util.Map Collection java.util.Collection Iterable java.lang.Iterable ArrayList java.util.ArrayList HashMap java.util.HashMap HashSet java.util.HashSet".split()
STUBS = {"Object": "java.lang", "String": "java.lang", "Integer": "java.lang", "Boolean": "java.lang", "List": "java.util", "Map": "java.util", "Set": "java.util", "Collection": "java.util", "Iterable": "java.lang", "Exception": "java.lang", "RuntimeException": "java.lang", "Throwable": "java.lang"}
# Names never drawn in a diagram.
SYSTEM_NAMES = "SystemNode Unknown Entity void boolean int long float double char byte short String Object args package const java androidx Volatile null true false this super undefined NaN 0 1 2 3 4 5 Node_0 Node_1 Node_2 Node_3 Node_4 Node_5 Node_100 let var function return if else for while do switch case break continue try catch MB".split()
VISIBILITY = {"public": "+", "private": "-", "protected": "#", "package": "~"}


def lookup(col: Column, table: dict[str, list[str]], otherwise: str | None = None) -> Column:
    """The key whose list holds the value."""
    out = reduce(lambda w, kv: w.when(col.isin(kv[1]), F.lit(kv[0])), table.items(), F)
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


# positions and attributes


def sort_key(file_id: Column, line: Column, col: Column, dup: Column) -> Column:
    """file in the top 16 bits, then 24 of line, 16 of column and 8 of the ordinal among tokens at one place."""
    part = lambda x, bits, at: F.shiftleft(x.cast("long").bitwiseAND((1 << bits) - 1), at)
    return part(file_id, 16, 48).bitwiseOR(part(line, 24, 24)).bitwiseOR(part(col, 16, 8)).bitwiseOR(part(dup, 8, 0))


def unpack_sort_key(key: Column) -> dict[str, Column]:
    cut = lambda at, bits: F.shiftrightunsigned(key, at).bitwiseAND((1 << bits) - 1)
    return {"file_id": cut(48, 16), "line": cut(24, 24), "col": cut(8, 16), "dup": cut(0, 8)}


def pack_attr(visibility: Column, modifiers: Column, operator: Column, aux: Column, lang: Column) -> Column:
    part = lambda x, bits, at: F.shiftleft(x.cast("long").bitwiseAND((1 << bits) - 1), at)
    return part(visibility, 4, 28).bitwiseOR(part(modifiers, 8, 20)).bitwiseOR(part(operator, 8, 12)).bitwiseOR(part(aux, 4, 8)).bitwiseOR(part(lang, 8, 0))


def unpack_attr(attr: Column) -> dict[str, Column]:
    cut = lambda at, bits: F.shiftrightunsigned(attr, at).bitwiseAND((1 << bits) - 1)
    return {"visibility": cut(28, 4), "modifiers": cut(20, 8), "operator": cut(12, 8), "aux": cut(8, 4), "lang": cut(0, 8)}


# languages and paths


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def detect_language(path: Column, overrides: dict[str, str] | None = None) -> Column:
    ext, own = extension(path), overrides or {}
    found = lookup(F.lower(ext), LANGUAGES, "Unknown")
    return F.coalesce(lookup(ext, {v: [k for k in own if own[k] == v] for v in own.values()}), found) if own else found


def is_cli_source(path: Column) -> Column:
    return F.lower(extension(path)).isin("java", "kt", "kts")


def is_server_source(path: Column) -> Column:
    """Taken by a server-side scan: a source file outside hidden, build, vendor and test directories that isn't named as a test."""
    low, stem = F.lower(path), F.lower(file_stem(path))
    dirs = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    tests = "|".join(d[1:] for d in TEST_DIRS)
    named = stem.rlike(r"(tests?|_spec)$") | stem.startswith("test_")
    exts = [e for es in LANGUAGES.values() for e in es] + OTHER_SOURCES
    return F.lower(extension(path)).isin(exts) & ~low.rlike(rf"(^|/)({dirs})/") & ~path.rlike(r"(^|/)\.[^/]*") & ~low.rlike(rf"(^|/)({tests})/") & ~named


def is_test_path(path: Column) -> Column:
    low, base = F.lower(path), F.regexp_extract(path, r"([^/]*)$", 1)
    return low.rlike(r"/src/tests?/|/__tests__/|/androidtest/") | base.rlike(r"(Test\.java|Test\.kt|Tests\.java|_test\.py)$") | base.startswith("test_")


def repo_owner_and_name(url: Column) -> tuple[Column, Column]:
    """Of a URL on the code host's site; null for any other."""
    pattern = r"^\s*https?://github\.com/([^/\s]+)/([^/\s]+?)(\.git)?(/.*)?\s*$"
    part = lambda i: F.nullif(F.regexp_replace(F.regexp_extract(url, pattern, i), r"\.\.|\\", ""), F.lit(""))
    return part(1), part(2)


# token and node classes


def classify_token(text: Column) -> Column:
    """Class of a lexical token of Java by its text."""
    return (
        F.when(text.isin(["true", "false"]), "BooleanLiteral").when(text == "null", "NullLiteral").when(text == "var", "JavaVarKeyword").when(text == "@", "JavaAnnotationMarker")
        .when(text.isin(KEYWORDS), "Keyword").when(text.isin(OPERATORS), "Operator").when(text.isin(PUNCTUATION), "Punctuation")
        .when(text.rlike(r"^[0-9]+$"), "IntegerLiteral").when(text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), "Identifier").when(text.rlike(r"^\s+$"), "Whitespace").otherwise("Unknown")
    )


def classify_generic(kind: Column) -> Column:
    """Class of a leaf of a generic grammar by its kind; letters only, and at least two, is a keyword."""
    ops = [o for o in OPERATORS if o not in (">>>", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=")] + ["===", "!==", "=>"]
    return (
        F.when(kind.isin("identifier", "property_identifier", "shorthand_property_identifier", "type_identifier"), "Identifier").when(kind.isin("number", "integer", "decimal_integer_literal"), "IntegerLiteral")
        .when(kind.isin("float", "decimal_floating_point_literal"), "FloatLiteral").when(kind.isin("string", "string_literal", "template_string"), "StringLiteral").when(kind.isin("true", "false"), "BooleanLiteral")
        .when(kind.isin("null", "undefined"), "NullLiteral").when(kind.isin("comment", "line_comment"), "CommentLine").when(kind == "block_comment", "CommentBlock")
        .when(kind.isin(ops), "Operator").when(kind.isin([p for p in PUNCTUATION if p not in ("...", "::", "->")] + [":"]), "Punctuation").when(kind.rlike(r"^[A-Za-z_]{2,}$"), "Keyword").otherwise("Unknown")
    )


# Classes of a Kotlin token by its kind, and node types that kinds of a generic grammar are kept as.
KOTLIN_KINDS = {
    "Identifier": "identifier type_identifier simple_identifier".split(),
    "IntegerLiteral": "decimal_integer_literal hex_integer_literal binary_integer_literal integer_literal".split(),
    "FloatLiteral": "decimal_floating_point_literal hex_floating_point_literal real_literal".split(),
    "StringLiteral": "string_literal text_block line_string_literal multi_line_string_literal".split(),
    "CharLiteral": "character_literal".split(),
    "BooleanLiteral": "true false".split(),
    "NullLiteral": "null_literal null".split(),
    "CommentLine": "line_comment".split(),
    "CommentBlock": "block_comment comment".split(),
    "Operator": "+ - * / % == != < > <= >= && || ! & | ^ ~ << >> >>> = += -= *= /= %= &= |= ^= <<= >>= >>>= ++ -- -> ?: !! .. ::".split(),
    "Keyword": "class interface enum record extends implements public private protected static final abstract synchronized native transient volatile strictfp default package import if else switch case while do for break continue return throw throws try catch finally new this super instanceof void fun val var object companion data sealed open override internal when in is by".split(),
    "Punctuation": "{ } ( ) [ ] ; , . : ? @".split(),
}
GENERIC_NODES = {
    "MODULE": "program module translation_unit source_file".split(),
    "CLASS_DECL": "class_declaration class_definition class class_specifier object_declaration struct_item struct_specifier union_item type_alias_declaration".split(),
    "INTERFACE_DECL": "interface_declaration interface trait_item protocol_declaration".split(),
    "ENUM_DECL": "enum_declaration enum_specifier enum_item".split(),
    "METHOD_DECL": "method_declaration method_definition function_declaration function_definition function arrow_function function_item function_component".split(),
    "CONSTRUCTOR_DECL": "constructor_declaration constructor".split(),
    "FIELD_DECL": "field_declaration field_definition property_definition public_field_definition".split(),
    "PARAM_DECL": "formal_parameter parameter required_parameter".split(),
    "LOCAL_VAR_DECL": "local_variable_declaration lexical_declaration variable_declaration variable_declarator let_declaration".split(),
    "BLOCK": "statement_block block compound_statement".split(),
    "IF_STMT": "if_statement".split(),
    "FOR_STMT": "for_statement for_in_statement for_of_statement".split(),
    "WHILE_STMT": "while_statement".split(),
    "DO_WHILE_STMT": "do_statement".split(),
    "SWITCH_STMT": "switch_statement".split(),
    "SWITCH_CASE": "switch_case case_clause".split(),
    "TRY_STMT": "try_statement".split(),
    "CATCH_CLAUSE": "catch_clause".split(),
    "FINALLY_CLAUSE": "finally_clause".split(),
    "RETURN_STMT": "return_statement".split(),
    "THROW_STMT": "throw_statement".split(),
    "BREAK_STMT": "break_statement".split(),
    "CONTINUE_STMT": "continue_statement".split(),
    "EXPR_STMT": "expression_statement".split(),
    "ASSIGN_EXPR": "assignment_expression".split(),
    "BINARY_EXPR": "binary_expression".split(),
    "UNARY_EXPR": "unary_expression update_expression".split(),
    "TERNARY_EXPR": "ternary_expression conditional_expression".split(),
    "CALL_EXPR": "call_expression method_invocation".split(),
    "NEW_EXPR": "new_expression object_creation_expression".split(),
    "FIELD_ACCESS": "member_expression field_access".split(),
    "ARRAY_ACCESS": "subscript_expression array_access".split(),
    "LITERAL": "number integer decimal_integer_literal string string_literal template_string true false null undefined".split(),
    "THIS_EXPR": "this super".split(),
}


def classify_kotlin(kind: Column) -> Column:
    """Class of a Kotlin token by its kind."""
    return lookup(kind, KOTLIN_KINDS, "Unknown")


def reduce_generic(kind: Column) -> Column:
    """The node type that a node of a generic grammar is kept as, by its kind; null where it goes and its children take its place. Kinds not listed are kept by what they are called: declarations and definitions, then statements and expressions."""
    named = lookup(kind, GENERIC_NODES)
    return F.coalesce(named, F.when(kind.rlike("declaration|definition"), "LOCAL_VAR_DECL").when(kind.rlike("statement|expression"), "EXPR_STMT"))


def encode_attrs(modifiers: Column, operator: Column) -> Column:
    """Visibility (public before private before protected), modifiers and operator of a node, packed."""
    vis = F.when(modifiers.contains("public"), 1).when(modifiers.contains("private"), 2).when(modifiers.contains("protected"), 3).otherwise(0)
    flag = lambda word, bit: F.when(modifiers.contains(word), bit).otherwise(0)
    op = reduce(lambda w, kv: w.when(operator == kv[0], kv[1]), {"=": 0x01, "+": 0x10, "-": 0x11, "*": 0x12, "/": 0x13, "==": 0x15, "!=": 0x16, "&&": 0x1B, "||": 0x1C}.items(), F).otherwise(0)
    return pack_attr(vis, flag("static", 1) + flag("final", 2) + flag("abstract", 4), op, F.lit(0), F.lit(0))


#: Kinds of symbols by the kinds of nodes that declare them.
SYMBOL_KINDS = {"MODULE": ["MODULE"], "CLASS": ["CLASS_DECL"], "INTERFACE": ["INTERFACE_DECL"], "ENUM": ["ENUM_DECL"], "RECORD": ["RECORD_DECL"], "ANNOTATION": ["ANNOTATION_DECL"], "METHOD": ["METHOD_DECL"], "CONSTRUCTOR": ["CONSTRUCTOR_DECL"], "FIELD": ["FIELD_DECL"], "PARAM": ["PARAM_DECL"], "LOCAL_VAR": ["LOCAL_VAR_DECL"], "LAMBDA": ["LAMBDA_EXPR"], "TYPE_PARAM": ["TYPE_PARAM"], "STATIC_INIT": ["STATIC_INIT"], "LABEL": ["LABELED_STMT"]}


def symbol_kind(node_type: Column) -> Column:
    return lookup(node_type, SYMBOL_KINDS)


def scope_kind(node_type: Column) -> Column:
    return lookup(node_type, {"FILE": ["MODULE"], "CLASS": ["CLASS_DECL", "INTERFACE_DECL", "ENUM_DECL", "RECORD_DECL", "ANNOTATION_DECL"], "METHOD": ["METHOD_DECL", "CONSTRUCTOR_DECL", "LAMBDA_EXPR"], "BLOCK": ["BLOCK", "FOR_STMT", "ENHANCED_FOR", "CATCH_CLAUSE"]})


def is_declaration(node_type: Column) -> Column:
    return symbol_kind(node_type).isNotNull()


def default_visibility(kind: Column) -> Column:
    return F.when(kind.isin("CLASS", "INTERFACE", "ENUM", "RECORD"), "package").otherwise("public")


def stereotype(kind: Column, modifiers: Column) -> Column:
    return F.when(kind == "INTERFACE", "interface").when(kind == "ENUM", "enum").when(kind == "RECORD", "record").when(kind == "ANNOTATION", "annotation").when(F.array_contains(modifiers, "abstract"), "abstract").otherwise("none")


def call_type(node_type: Column, n_children: Column, target_modifiers: Column, target_visibility: Column, owner_kind: Column) -> Column:
    return (
        F.when(node_type == "NEW_EXPR", "CONSTRUCTOR").when(node_type.isin("METHOD_REF", "LAMBDA_EXPR"), "DYNAMIC").when(n_children == 0, "SPECIAL")
        .when(F.array_contains(target_modifiers, "static"), "DIRECT").when(target_visibility == "private", "SPECIAL").when(owner_kind == "INTERFACE", "INTERFACE").otherwise("VIRTUAL")
    )


def activity_kind(is_entry: Column, is_exit: Column, n_in: Column, n_out: Column) -> Column:
    return F.when(is_entry, "INITIAL").when(is_exit | (n_out == 0), "FINAL").when((n_in >= 2) & (n_out == 1), "MERGE").when(n_out == 2, "DECISION").otherwise("ACTION")


def rebuild_scope(change: Column) -> Column:
    return F.when(change == "trivia", "None").when(change == "body", "Behavioral").when(change == "type", "Structural").otherwise("Full")


# hashes


def _bytewise(step):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else step(bytes(b)))

    return run


def _fnv(raw: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in raw:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


_CRC64 = []
for _i in range(256):
    _c = _i << 56
    for _ in range(8):
        _c = ((_c << 1) ^ 0x42F0E1EBA9EA3693 if _c >> 63 else _c << 1) & 0xFFFFFFFFFFFFFFFF
    _CRC64.append(_c)


def _crc64(raw: bytes) -> int:
    c = 0
    for b in raw:
        c = (_CRC64[(c >> 56) ^ b] ^ (c << 8)) & 0xFFFFFFFFFFFFFFFF
    return c - (1 << 64) if c >> 63 else c


def fnv1a(col: Column) -> Column:
    return F.pandas_udf(_bytewise(_fnv), "long")(col.cast("binary"))


def crc64(col: Column) -> Column:
    """CRC-64 of the ECMA polynomial."""
    return F.pandas_udf(_bytewise(_crc64), "long")(col.cast("binary"))


def le_bytes(col: Column) -> Column:
    """Eight little-endian bytes of a long."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(col, 8 * i).bitwiseAND(255)), 2, "0") for i in range(8)]))


def composite_hash(*layers: Column) -> Column:
    """CRC-32 of the exclusive or of the layers' hashes."""
    return F.crc32(le_bytes(reduce(lambda a, b: a.bitwiseXOR(b), layers)))


def folded_hash(*layers: Column) -> Column:
    """The exclusive or of the layers' hashes, its halves laid over one another."""
    x = reduce(lambda a, b: a.bitwiseXOR(b), layers)
    return x.bitwiseAND(0xFFFFFFFF).bitwiseXOR(F.shiftrightunsigned(x, 32))


# names


def sanitize(name: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_]", "_")
    return F.when(clean.isin("", "Unknown", "Entity", "void", "boolean"), "SystemNode").when(clean.rlike(r"^\p{N}"), F.concat(F.lit("Node_"), clean)).otherwise(clean)


def is_system_name(name: Column) -> Column:
    return name.isin(SYSTEM_NAMES)


def is_class_name(name: Column, stem: Column) -> Column:
    """A drawable class name: an identifier, no constant, no trailing underscore, no generated binding or reserved word, capitalised or named as its file."""
    constant = (F.length(name) >= 3) & name.contains("_") & name.rlike(r"^[A-Z_0-9]+$")
    reserved = [w for w in KEYWORDS if w.isalpha()] + "object struct trait impl fun function def fn val var let const module export require from true false null".split()
    return name.rlike(r"^[A-Za-z0-9_]+$") & ~constant & ~name.endswith("_") & ~name.endswith("Binding") & ~name.isin(reserved) & (name.rlike(r"^[A-Z]") | (name == stem))


def visibility_glyph(visibility: Column) -> Column:
    return reduce(lambda w, kv: w.when(visibility == kv[0], kv[1]), VISIBILITY.items(), F).otherwise("~")


def truncated(label: Column, most: int = 40) -> Column:
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, most - 3), F.lit("..."))).otherwise(label)


def package_alias(package: Column) -> Column:
    return F.concat(F.lit("pkg_"), F.translate(package, ".-", "__"))


def span_text(l0: Column, c0: Column, l1: Column, c1: Column) -> Column:
    return F.format_string("L%d:C%d - L%d:C%d", l0, c0, l1, c1)
