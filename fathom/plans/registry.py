"""Names of queries to what they do, with the SQL of the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from fathom.sources.tables import Tables

#: name -> (query, SQL or None)
KNOWN: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def add(f):
        if f.__name__ in KNOWN:
            raise ValueError(f"two queries called {f.__name__}")
        KNOWN[f.__name__] = (lambda spark, folder: f(Tables(spark, folder)), sql)
        return f

    return add
