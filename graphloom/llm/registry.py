"""The queries of this subpackage by name, and SQL where it can express them."""

from __future__ import annotations

from graphloom.llm import ann, bpe, decontaminate, langid, licenses, lines, simhash, substrings, suffixes, toxicity


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_bpe": bpe.op2_bpe,
        "op3_suffixes": suffixes.op3_suffixes,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_substrings": substrings.op5_substrings,
        "op6_lines": lines.op6_lines,
        "op7_simhash": simhash.op7_simhash,
        "op8_langid": langid.op8_langid,
        "op9_ann": ann.op9_ann,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict:
    return {"op5_substrings": substrings.ORACLE, "op6_lines": lines.ORACLE}
