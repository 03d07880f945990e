"""Schemas of the program-graph tables. Missing values are nulls, never sentinels."""

from __future__ import annotations

from pyspark.sql import types as T

_DDL = {
    "files": "file_id long, path string, lang string, sha256 string, size long, mtime timestamp, first_token_id long, token_count long",
    "tokens": "token_id long, file_id long, line int, col int, sort_key long, text string, text_id long, len int, token_type string",
    "strings": "text_id long, text string",
    "ast": "node_id long, file_id long, pre long, parent long, depth int, size long, node_type string, op string, text string, first_tok long, last_tok long",
    "symbols": "sym_id long, name string, qual_name string, kind string, type_sym long, decl_node long, parent_sym long, scope_id long, ordinal int, param_count int, modifiers array<string>, visibility string, first_tok long, last_tok long",
    "scopes": "scope_id long, parent_scope long, owner_sym long, kind string",
    "imports": "scope_id long, simple_name string, qual_name string, is_wildcard boolean",
    "th_edges": "from_sym long, to_sym long, relation string",
    "associations": "from_sym long, to_sym long, field_sym long, kind string, mult_min int, mult_max int, role string",
    "blocks": "fn_sym long, block_id int, stmts array<long>, first_tok long, last_tok long, is_entry boolean, is_exit boolean",
    "cfg_edges": "fn_sym long, src int, dst int, edge_type string",
    "dom": "fn_sym long, block int, idom int, ipdom int",
    "dom_frontier": "fn_sym long, block int, frontier int",
    "ssa_defs": "fn_sym long, ssa_id long, var string, version int, def_stmt long, def_block int, is_phi boolean",
    "phis": "fn_sym long, ssa_id long, block int, var string, args array<struct<pred:int,arg:long>>",
    "def_use": "fn_sym long, ssa_id long, use_stmt long",
    "cdg": "fn_sym long, controller int, dependent int, label string",
    "call_sites": "site_id long, caller long, node long, block int, token long, call_type string, arg_count int",
    "call_edges": "caller long, callee long, site_id long, edge_type string",
    "scc": "sym long, scc_id long, scc_size long, scc_class int",
    "entity_spans": "layer string, entity_id long, file_id long, first_tok long, last_tok long, line_start int, col_start int, line_end int, col_end int",
    "path_metrics": "fn_sym long, cyclomatic int, max_path_len int, sat_count decimal(20,0), acyclic_path_count decimal(20,0), unwind_depth int",
    "patterns": "class_sym long, pattern string, confidence int",
}


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(_DDL[table])


TABLES = tuple(_DDL)
