"""Java sources to program-graph tables: one pass over files, in parallel, each parsed once into one row that all tables are taken from."""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.javaparse import cfg as C
from graphloom.javaparse.parser import _PRIMITIVES, flatten, parse
from graphloom.javaparse.scopes import Scopes

_CALLABLE = ("METHOD_DECL", "CONSTRUCTOR_DECL")
_CALLS = ("CALL_EXPR", "NEW_EXPR", "METHOD_REF")
#: Nodes of a file have ids file_id * STRIDE + pre.
STRIDE = 1 << 24


#: Calls of Python functions within one another that a parse may need; they take heap, not stack.
DEEP = 1_000_000

_L, _I, _S, _B = pa.int64(), pa.int32(), pa.string(), pa.bool_()
_NODE = {"node_id": _L, "pre": _L, "parent": _L, "depth": _I, "size": _L, "node_type": _S, "op": _S, "text": _S, "modifiers": pa.list_(_S), "first_tok": _L, "last_tok": _L}
#: The lists of a parsed file, with their fields. heads are the nodes that tell of packages, imports and supertypes; decls and calls hold all that the tree says of a declaration (the chain is its own id and those around it, from the inside out) and of a call.
LISTS = {
    "tokens": {"ord": _L, "line": _I, "col": _I, "text": _S, "len": _I, "token_type": _S},
    "ast": dict(_NODE),
    "heads": dict(_NODE),
    "decls": {"sym_id": _L, "pre": _L, "node_type": _S, "name": _S, "modifiers": pa.list_(_S), "first_tok": _L, "last_tok": _L, "chain": pa.list_(_L), "type_name": _S, "is_array": _B},
    "calls": {"site_id": _L, "caller": _L, "name": _S, "node_type": _S, "arg_count": _I, "first_tok": _L, "last_tok": _L},
    "blocks": {"fn_sym": _L, "block": _I, "stmts": pa.list_(_L), "is_entry": _B, "is_exit": _B},
    "cfg_edges": {"fn_sym": _L, "src": _I, "dst": _I, "edge_type": _S},
    "statements": {"fn_sym": _L, "stmt": _L, "block": _I, "uses": pa.list_(_S), "defs": pa.list_(_S)},
    "receivers": {"site_id": _L, "fn_sym": _L, "owner": _L, "how": _S, "type_name": _S, "variable": _S},
    "given": {"fn_sym": _L, "variable": _S, "type_name": _S, "other": _S},
}


FACTS = ("heads", "decls", "calls", "receivers", "given")
#: Lists that hold most of a file's rows and that few questions read. As one packed value for each file they are written and read in a fraction of the time that Spark takes for nested rows.
PACKED = ("tokens", "ast", "blocks", "cfg_edges", "statements")
_NAMES = {_L: "long", _I: "int", _S: "string", _B: "boolean", pa.list_(_S): "array<string>", pa.list_(_L): "array<long>"}


def _columns(name: str) -> str:
    return ", ".join(f"{c} {_NAMES[t]}" for c, t in LISTS[name].items())


def _arrays(name: str, rows: list[tuple]) -> list[pa.Array]:
    each = list(zip(*rows, strict=True)) or [[]] * len(LISTS[name])
    return [pa.array(c, t) for c, t in zip(each, LISTS[name].values(), strict=True)]


def _packed(name: str, rows: list[tuple]) -> bytes:
    return pa.record_batch(_arrays(name, rows), schema=pa.schema(list(LISTS[name].items()))).serialize().to_pybytes()


def _opened(files: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(file_id, rows) of a batch of packed files."""
    schema = pa.schema(list(LISTS[name].items()))
    for i, held in zip(files.column("file_id").to_pylist(), files.column(name), strict=True):
        yield i, pa.ipc.read_record_batch(held.as_buffer(), schema)


#: What resolution reads of a tree besides declarations and calls: files, packages, imports and what types are built on.
_HEADS = frozenset(("MODULE", "PACKAGE_DECL", "IMPORT_DECL"))
_DECLARES = frozenset(t for types in S.SYMBOL_KINDS.values() for t in types)
#: Nodes that are written at once, at least, whatever the number of files.
_AT_ONCE = 1 << 14


def _around(rows: list[dict], marked) -> list[int | None]:
    """Of every node the nearest one around it of the marked types."""
    out: list[int | None] = [None] * len(rows)
    for r in rows:
        up = r["parent"]
        if up is not None:
            out[r["pre"]] = up if rows[up]["node_type"] in marked else out[up]
    return out


def _node(i: int, r: dict) -> tuple:
    return (i * STRIDE + r["pre"], r["pre"], r["parent"], r["depth"], r["size"], r["node_type"], r["op"], r["text"], r["modifiers"], r["first_tok"], r["last_tok"])


def _facts(i: int, rows: list[dict], scopes: Scopes) -> dict[str, list[tuple]]:
    """What names and calls are resolved by: heads, decls, calls, receivers, given."""
    at = lambda pre: None if pre is None else i * STRIDE + pre
    heads, decls, calls = [], [], []
    outer, inside = _around(rows, _DECLARES), _around(rows, _CALLABLE)
    chain: dict[int | None, list[int]] = {None: []}  # a declaration's id and those around it
    for r in rows:
        kind, pre = r["node_type"], r["pre"]
        if kind in _HEADS or (kind == "TYPE_REF" and r["op"] in ("extends", "implements")):
            heads.append(_node(i, r))
        if kind in _DECLARES:
            chain[pre] = [at(pre), *chain[outer[pre]]]
            of = next((rows[k] for k in scopes.kids.get(pre, ()) if rows[k]["node_type"] == "TYPE_REF" and rows[k]["op"] in (None, "[]")), None)
            decls.append((at(pre), pre, kind, r["text"], r["modifiers"], r["first_tok"], r["last_tok"], chain[pre], of and of["text"], of is not None and of["op"] == "[]"))
        elif kind in _CALLS and inside[pre] is not None:
            calls.append((at(pre), at(inside[pre]), r["text"], kind, max(len(scopes.kids.get(pre, ())) - 1, 0), r["first_tok"], r["last_tok"]))
    receivers = [(at(call), at(fn), at(owner), *rest) for call, fn, owner, *rest in scopes.calls()]
    return {"heads": heads, "decls": decls, "calls": calls, "receivers": receivers, "given": [(at(fn), *rest) for fn, *rest in scopes.given()]}


def _flow(i: int, rows: list[dict], scopes: Scopes) -> dict[str, list[tuple]]:
    """Blocks, edges and statements of all callables."""
    at = lambda pre: i * STRIDE + pre
    out: dict[str, list[tuple]] = {"blocks": [], "cfg_edges": [], "statements": []}
    for r in rows:
        if r["node_type"] in _CALLABLE:
            fn, (blocks, edges) = at(r["pre"]), C.build(rows, r["pre"])
            out["blocks"] += [(fn, b, [at(s) for s in ss], e, x) for b, ss, e, x in blocks]
            out["cfg_edges"] += [(fn, s, d, k) for s, d, k in edges]
            # parameters are set by the callable itself in block 0
            out["statements"].append((fn, fn, 0, [], [rows[k]["text"] for k in scopes.kids.get(r["pre"], []) if rows[k]["node_type"] == "PARAM_DECL"]))
            out["statements"] += [(fn, at(s), b, *C.uses_and_defs(rows, scopes.kids, s)) for b, ss, _, _ in blocks for s in ss]
    return out


#: What a source may raise where it can't be read.
_UNREADABLE = (RecursionError, ValueError, LookupError, TypeError, AttributeError)


def _parsed(i: int, text: str, lists) -> tuple[dict[str, list[tuple]], str | None]:
    """The lists asked for and what went wrong. Where the control flow can't be built, the rest of the file stays."""
    out, said = {}, lambda e: f"{type(e).__name__}: {e}"
    try:
        read, root = parse(text)
        rows = flatten(root)
        scopes = Scopes(rows)
        out = _facts(i, rows, scopes)
        if "tokens" in lists:
            out["tokens"] = [(k, x.line, x.col, x.text, len(x.text), x.kind) for k, x in enumerate(read)]
        if "ast" in lists:
            out["ast"] = [_node(i, r) for r in rows]
    except _UNREADABLE as e:
        return {}, said(e)
    if "blocks" in lists:
        try:
            out |= _flow(i, rows, scopes)
        except _UNREADABLE as e:
            return out, said(e)
    return out, None


def parsed(files: DataFrame, packed: tuple[str, ...] = (), lists: tuple[str, ...] = tuple(LISTS)) -> DataFrame:
    """(file_id, error, and a list of structs for each of those asked for, as one packed value for those named): a row for each file. A file that can't be read has empty lists and says why; it does the others no harm."""
    kinds = {k: pa.struct(list(fields.items())) for k, fields in LISTS.items()}
    ddl = "file_id long, error string, " + ", ".join(f"{k} binary" if k in packed else f"{k} array<struct<{_columns(k).replace(' ', ':').replace(',:', ', ')}>>" for k in lists)

    def made(ids: list, errors: list, ends: dict, held: dict) -> pa.RecordBatch:
        cols = []
        for k in lists:
            if k in packed:
                cols.append(pa.array([_packed(k, held[k][a:b]) for a, b in pairwise(ends[k])], pa.binary()))
            else:
                cols.append(pa.ListArray.from_arrays(pa.array(ends[k], pa.int32()), pa.StructArray.from_arrays(_arrays(k, held[k]), fields=list(kinds[k]))))
        return pa.RecordBatch.from_arrays([pa.array(ids, _L), pa.array(errors, _S), *cols], names=["file_id", "error", *lists])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, collects = sys.getrecursionlimit(), gc.isenabled()
        sys.setrecursionlimit(max(before, DEEP))
        gc.disable()
        gc.freeze()  # trees are let go whole; what refers to itself goes once for every written batch
        try:
            for batch in batches:
                ids, errors, ends, held = [], [], {k: [0] for k in lists}, {k: [] for k in lists}
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found, error = _parsed(i, text or "", lists)
                    ids.append(i)
                    errors.append(error)
                    for k in lists:
                        held[k] += found.get(k, ())
                        ends[k].append(len(held[k]))
                    if max(map(len, held.values())) >= _AT_ONCE:
                        yield made(ids, errors, ends, held)
                        ids, errors, ends, held = [], [], {k: [0] for k in lists}, {k: [] for k in lists}
                        gc.collect()
                if ids:
                    yield made(ids, errors, ends, held)
        finally:
            sys.setrecursionlimit(before)
            gc.unfreeze()
            if collects:
                gc.enable()

    return spread(files.select("file_id", "text"), "file_id").mapInArrow(work, ddl)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt to four tasks for each core at least: what Python does with a row takes much longer than its bytes let Spark expect, which would put small tables into one task. By a hash of their own, as a shuffle that rows already lie by would be taken over with its few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(*by))


def listed(files: DataFrame, name: str) -> DataFrame:
    """One of LISTS as rows. files is what parsed() gives."""
    if dict(files.dtypes)[name] == "binary":
        schema = pa.schema([("file_id", _L), *LISTS[name].items()])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, n = [], 0
                for i, rows in _opened(batch, name):
                    held.append(pa.record_batch([pa.array([i] * rows.num_rows, _L), *rows.columns], schema=schema))
                    n += rows.num_rows
                    if n >= _AT_ONCE:
                        yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches(_AT_ONCE)
                        held, n = [], 0
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches(_AT_ONCE)

        rows = files.select("file_id", name).mapInArrow(work, f"file_id long, {_columns(name)}")
    else:
        rows = files.select("file_id", F.explode(name).alias("x")).select("file_id", "x.*")
    return rows if name in ("tokens", "ast", "heads", "decls", "calls") else rows.drop("file_id")


def sizes(files: DataFrame, name: str) -> DataFrame:
    """(file_id, token_count): rows of a packed list by file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(i, rows.num_rows) for i, rows in _opened(batch, name)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], _L), pa.array([n for _, n in held], _L)], names=["file_id", "token_count"])

    return files.select("file_id", name).mapInArrow(work, "file_id long, token_count long")


def unpacked(files: DataFrame, name: str) -> DataFrame:
    """(file_id, name) with a packed list as one of structs again."""
    kind = pa.struct(list(LISTS[name].items()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, rows in _opened(batch, name):
                held = pa.StructArray.from_arrays(rows.columns, fields=list(kind))
                yield pa.RecordBatch.from_arrays([pa.array([i], _L), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)], names=["file_id", name])

    return files.select("file_id", name).mapInArrow(work, f"file_id long, {name} array<struct<{_columns(name).replace(' ', ':').replace(',:', ', ')}>>")


def errors(files: DataFrame) -> DataFrame:
    """(file_id, error) of files that couldn't be read."""
    return files.filter("error IS NOT NULL").select("file_id", "error")


def symbols(files: DataFrame) -> DataFrame:
    """Declarations as symbols: (sym_id, file_id, name, kind, parent_sym, visibility, modifiers, is_static, is_abstract, is_final, type_name, is_array, pre, first_tok, last_tok). parent_sym is the nearest declaration around."""
    kind = S.symbol_kind(F.col("node_type"))
    has = lambda m: F.array_contains("modifiers", m)
    vis = F.when(has("public"), "public").when(has("private"), "private").when(has("protected"), "protected").otherwise(S.default_visibility(F.col("kind")))
    rows = listed(files, "decls").withColumn("kind", kind)
    return rows.select("sym_id", "file_id", "name", "kind", F.get("chain", F.lit(1)).alias("parent_sym"), vis.alias("visibility"), "modifiers", has("static").alias("is_static"), has("abstract").alias("is_abstract"), has("final").alias("is_final"), "type_name", "is_array", "pre", "first_tok", "last_tok")


def packages(nodes: DataFrame) -> DataFrame:
    """(file_id, package): "" for files without one."""
    named = nodes.filter("node_type = 'PACKAGE_DECL'").groupBy("file_id").agg(F.min_by("text", "pre").alias("package"))
    return nodes.select("file_id").distinct().join(named, "file_id", "left").fillna("", ["package"])


def imports(nodes: DataFrame) -> DataFrame:
    """(file_id, qual_name, simple_name, is_wildcard)"""
    text = F.regexp_replace("text", r"^static\s+", "")
    wild = text.endswith("*")
    rows = nodes.filter("node_type = 'IMPORT_DECL'").select("file_id", text.alias("t"), wild.alias("is_wildcard"))
    return rows.select("file_id", F.when(F.col("is_wildcard"), F.regexp_replace("t", r"\.?\*$", "")).otherwise(F.col("t")).alias("qual_name"), F.regexp_extract("t", r"([^.]*)$", 1).alias("simple_name"), "is_wildcard")


_CLASSES = ("CLASS", "INTERFACE", "ENUM", "RECORD")


def chains(files: DataFrame) -> DataFrame:
    """(scope_id, outer, dist): every symbol and the symbols around it."""
    rows = listed(files, "decls").select(F.col("sym_id").alias("scope_id"), F.posexplode("chain").alias("dist", "outer"))
    return rows.select("scope_id", "outer", F.col("dist").cast("long").alias("dist"))


def resolved_types(uses: DataFrame, syms: DataFrame, nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """(use_id, type_sym) of uses (use_id, file_id, scope, name), scope being the symbol around: a type of that name declared in the innermost scope outwards up to the file, else by an import, in the package, by a wildcard import. What none has is left out."""
    types = syms.filter(F.col("kind").isin(*_CLASSES)).select("sym_id", "file_id", "name", "parent_sym")
    package = packages(nodes)
    modules = syms.filter("kind = 'MODULE'").select(F.col("sym_id").alias("parent_sym"))
    top = types.join(modules, "parent_sym", "left_semi").unionByName(types.filter("parent_sym IS NULL")).join(package, "file_id")
    wanted = uses.filter(F.col("name").isNotNull() & ~F.col("name").isin(*_PRIMITIVES)).withColumn("simple", F.regexp_extract("name", r"([^.]*)$", 1)).withColumn("before", F.regexp_replace("name", r"\.?[^.]*$", ""))
    plain = wanted.filter("before = ''")
    nested = plain.join(chain.withColumnRenamed("scope_id", "scope"), "scope").join(types.select(F.col("parent_sym").alias("outer"), F.col("name").alias("simple"), F.col("sym_id").alias("type_sym")), ["outer", "simple"]).select("use_id", F.col("dist").cast("long").alias("rank"), "type_sym")
    at = lambda rank: F.lit(1 << 40 | rank).alias("rank")  # noqa: E731  behind all scopes of the file
    full = top.select(F.when(F.col("package") == "", F.col("name")).otherwise(F.concat("package", F.lit("."), "name")).alias("qual_name"), F.col("sym_id").alias("type_sym"))
    named = imports(nodes)
    imported = plain.join(named.filter("NOT is_wildcard").select("file_id", F.col("simple_name").alias("simple"), "qual_name"), ["file_id", "simple"]).join(full, "qual_name").select("use_id", at(1), "type_sym")
    neighbours = top.select("package", F.col("name").alias("simple"), F.col("sym_id").alias("type_sym"))
    near = plain.join(package, "file_id").join(neighbours, ["package", "simple"]).select("use_id", at(2), "type_sym")
    wild = plain.join(named.filter("is_wildcard").select("file_id", F.col("qual_name").alias("package")), "file_id").join(neighbours, ["package", "simple"]).select("use_id", at(3), "type_sym")
    whole = wanted.filter("before <> ''").join(full.withColumnRenamed("qual_name", "name"), "name").select("use_id", at(1), "type_sym")
    found = nested.unionByName(imported).unionByName(near).unionByName(wild).unionByName(whole)
    return found.groupBy("use_id").agg(F.min_by("type_sym", F.struct("rank", "type_sym")).alias("type_sym"))


def supers(nodes: DataFrame, syms: DataFrame, chain: DataFrame) -> DataFrame:
    """(sym_id, super_sym): what classes name behind extends and implements, where it resolves to a type."""
    refs = nodes.filter("node_type = 'TYPE_REF' AND op IN ('extends', 'implements')").select(F.col("node_id").alias("use_id"), "file_id", F.col("parent").alias("pre"), F.col("text").alias("name"))
    own = syms.filter(F.col("kind").isin(*_CLASSES)).select("file_id", "pre", "sym_id", F.col("parent_sym").alias("scope"))
    uses = refs.join(own, ["file_id", "pre"])
    return uses.join(resolved_types(uses.select("use_id", "file_id", "scope", "name"), syms, nodes, chain), "use_id").select("sym_id", F.col("type_sym").alias("super_sym")).distinct()


def call_sites(files: DataFrame) -> DataFrame:
    """(site_id, file_id, caller, name, node_type, arg_count, token, first_tok, last_tok): calls and creations with the callable around them."""
    rows = listed(files, "calls")
    return rows.select("site_id", "file_id", "caller", "name", "node_type", F.col("arg_count").cast("long").alias("arg_count"), F.col("first_tok").alias("token"), "first_tok", "last_tok")


def callables(syms: DataFrame) -> DataFrame:
    """(callee, owner, key, is_static, is_abstract, visibility, owner_kind): callables by name and number of parameters; a constructor's name is its class's."""
    params = syms.filter("kind = 'PARAM'").groupBy(F.col("parent_sym").alias("callee")).agg(F.count("*").alias("arity"))
    owners = syms.select(F.col("sym_id").alias("owner"), F.col("kind").alias("owner_kind"))
    rows = syms.filter("kind IN ('METHOD', 'CONSTRUCTOR')").select(F.col("sym_id").alias("callee"), "name", "kind", "is_static", "is_abstract", "visibility", F.col("parent_sym").alias("owner"))
    rows = rows.join(params, "callee", "left").fillna(0, ["arity"]).join(owners, "owner", "left")
    return rows.withColumn("key", F.concat_ws("/", F.when(F.col("kind") == "CONSTRUCTOR", "new").otherwise("call"), "name", "arity"))


def typed_sites(sites: DataFrame, receivers: DataFrame, syms: DataFrame, th_edges: DataFrame, nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """Sites with type_sym (of the receiver, null where nothing tells it), key, target (the callable of that key in the type or the nearest above it), call_type and variable."""
    from graphloom.operators.closure import closure

    rows = sites.join(receivers.select("site_id", "owner", "how", "type_name", "variable"), "site_id", "left")
    known = resolved_types(rows.select(F.col("site_id").alias("use_id"), "file_id", F.col("caller").alias("scope"), F.col("type_name").alias("name")), syms, nodes, chain)
    extends = th_edges.filter("relation = 'EXTENDS'").groupBy(F.col("from_sym").alias("owner")).agg(F.min("to_sym").alias("above"))
    rows = rows.join(known.withColumnRenamed("use_id", "site_id"), "site_id", "left").join(extends, "owner", "left")
    rows = rows.withColumn("type_sym", F.when(F.col("how") == "own", F.col("owner")).when(F.col("how") == "super", F.col("above")).otherwise(F.col("type_sym"))).drop("above")
    made = F.col("node_type") == "NEW_EXPR"
    rows = rows.withColumn("key", F.concat_ws("/", F.when(made, "new").otherwise("call"), F.regexp_extract("name", r"([^.]*)$", 1), "arg_count"))
    up = th_edges.filter("relation IN ('EXTENDS', 'IMPLEMENTS')").select(F.col("from_sym").alias("src"), F.col("to_sym").alias("dst"))
    types = rows.select(F.col("type_sym").alias("root")).filter("root IS NOT NULL").distinct()
    above = closure(up, types.select("root", F.col("root").alias("node"))).select(F.col("root").alias("type_sym"), F.col("node").alias("owner"), "dist")
    held = callables(syms)
    asked = rows.select("site_id", "type_sym", "key")
    near = asked.join(above, "type_sym").join(held.select("owner", "key", "callee"), ["owner", "key"]).groupBy("site_id").agg(F.min_by("callee", F.struct("dist", "callee")).alias("target"))
    # an unqualified call may mean a type around the innermost one
    outer = asked.filter("type_sym IS NOT NULL").join(near, "site_id", "left_anti").join(rows.filter("how = 'own'").select("site_id"), "site_id", "left_semi")
    around = outer.join(chain.withColumnRenamed("scope_id", "type_sym"), "type_sym").join(held.select(F.col("owner").alias("outer"), "key", "callee"), ["outer", "key"]).groupBy("site_id").agg(F.min_by("callee", F.struct("dist", "callee")).alias("target"))
    # where nothing tells the receiver's type, a key that only one callable has
    only = held.groupBy("key").agg(F.count("*").alias("n"), F.min("callee").alias("target")).filter("n = 1").select("key", "target")
    loose = rows.filter("type_sym IS NULL").select("site_id", "key").join(only, "key").select("site_id", "target")
    found = rows.join(near.unionByName(around).unionByName(loose), "site_id", "left")
    of = held.select(F.col("callee").alias("target"), "is_static", F.col("visibility").alias("_v"), "owner_kind")
    kind = S.call_type(F.col("node_type"), F.lit(1), F.when(F.col("is_static"), F.array(F.lit("static"))).otherwise(F.array().cast("array<string>")), F.col("_v"), F.col("owner_kind"))
    return found.join(of, "target", "left").withColumn("call_type", F.when(F.col("how") == "super", "SPECIAL").otherwise(kind)).drop("_v", "owner_kind", "is_static")


def call_edges(sites: DataFrame, given: DataFrame, syms: DataFrame, th_edges: DataFrame, nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """(caller, callee, site_id, edge_type) of typed_sites(): direct calls to their target; virtual ones to the methods of the types that their receiver was given, else of its declared type and all below it. given is (fn_sym, variable, type_name, other)."""
    from graphloom.operators import callgraph

    held = callables(syms).select(F.lit("METHOD").alias("kind"), F.col("owner").alias("parent_sym"), F.col("key").alias("name"), F.col("callee").alias("sym_id"), "is_abstract")
    made = given.filter("type_name IS NOT NULL").withColumn("use_id", F.xxhash64("fn_sym", "variable", "type_name"))
    files = syms.select(F.col("sym_id").alias("fn_sym"), "file_id")
    types = resolved_types(made.join(files, "fn_sym").select("use_id", "file_id", F.col("fn_sym").alias("scope"), F.col("type_name").alias("name")).distinct(), syms, nodes, chain)
    seeds = made.join(types, "use_id").select("fn_sym", F.col("variable").alias("var"), "type_sym").distinct()
    copies = given.filter("other IS NOT NULL").select("fn_sym", F.col("other").alias("src"), F.col("variable").alias("dst"))
    held_by = callgraph.points_to(seeds, copies)
    asked = sites.select("site_id", F.col("caller").alias("fn_sym"), F.col("variable").alias("receiver"), "type_sym", F.col("key").alias("name"), "target", "call_type")
    # only variables of the function itself are followed; fields may be set anywhere
    locals_ = syms.filter("kind IN ('LOCAL_VAR')").select(F.col("parent_sym").alias("fn_sym"), F.col("name").alias("receiver")).distinct()
    one = callgraph.resolve_1cfa(asked.join(locals_, ["fn_sym", "receiver"], "left_semi").select("site_id", "fn_sym", "receiver", "name"), held_by, held)
    # only calls whose receivers' types matter, and are not known, ask the hierarchy
    open_ = asked.filter("call_type IN ('VIRTUAL', 'INTERFACE')").join(one.select("site_id").distinct(), "site_id", "left_anti")
    cha = callgraph.resolve_cha(open_, held, th_edges)
    found = callgraph.resolve_sites(asked, one, cha)
    return found.join(sites.select("site_id", "caller"), "site_id").select("caller", "callee", "site_id", "edge_type").distinct()
