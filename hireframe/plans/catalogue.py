"""Registry of the queries of the recruitment operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ["listing_queries", "etl_queries", "graph_queries", "dialogue_queries", "source_queries", "account_queries"]
_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir) and, if given, the SQL for its rows."""

    def register(f):
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return register


def _load() -> None:
    for name in MODULES:
        import_module(f"hireframe.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
