"""Every registered query and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL of the same columns."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


from tidewatch.plans import analysis, details, history, pages  # noqa: E402, F401
