"""Registry of named queries and their DuckDB oracle twins.

Every registered query takes ``(spark, sf_dir)`` and reads the driver tables
(or tables Spark derives from them); the oracle is the same computation in
ANSI SQL over the same tables, with the stand-in views inlined as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_KEPT: dict[tuple, str] = {}


def kept(spark, d: str, name: str, build: Callable[[str], None]) -> str:
    """The folder of something built from the tables of ``d`` (an index, a model, a map): built once per application,
    under the shared folder, as a table that others keep."""
    from quarry.sources.io import scratch_path
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _KEPT:
        folder = scratch_path(spark, f"kept-{name}")
        build(folder)
        _KEPT[key] = folder
    return _KEPT[key]


def load_all() -> None:
    # importing the modules fills the registry
    import importlib
    for mod in MODULES:
        importlib.import_module(f"quarry.plans.{mod}")


MODULES = ["q_search", "q_clean", "q_embed", "q_rerank", "q_evaluate", "q_feedback", "q_topics", "q_sources", "q_index"]
