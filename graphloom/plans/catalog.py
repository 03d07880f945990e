"""Every query of the library by name, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from graphloom.plans import q_flow, q_java, q_scalar, q_symbols, q_tokens, q_tree  # noqa: F401
from graphloom.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
