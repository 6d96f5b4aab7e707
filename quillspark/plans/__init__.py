"""Registered queries: every module of MODULES has queries() and oracle_sql()."""

from importlib import import_module

MODULES = ("hierarchy_queries", "sql_queries", "retrieval_queries", "store_queries", "streaming_queries")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"quillspark.plans.{module}"), name)()
    return out


def all_queries() -> dict:
    return _merged("queries")


def all_oracle_sql() -> dict:
    return _merged("oracle_sql")
