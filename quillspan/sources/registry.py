"""Sources by name: registration with collision checks, their union, and views as functions."""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Names to callables; a name is taken once, and registered functions are described by their docstrings."""

    def __init__(self) -> None:
        self._known: dict[str, Callable] = {}
        self._lock = Lock()

    def register(self, name: str, made: Callable | None = None):
        if made is None:
            return lambda f: self.register(name, f)
        with self._lock:
            if name in self._known:
                raise ValueError(f"{name} is registered")
            self._known[name] = made
        return made

    def unregister(self, name: str) -> None:
        with self._lock:
            self._known.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._known)

    def describe(self) -> dict[str, str]:
        return {n: (f.__doc__ or "").strip().split("\n")[0] for n, f in sorted(self._known.items())}

    def __call__(self, name: str, *args, **kwargs):
        if name not in self._known:
            raise KeyError(f"{name} is none of {', '.join(self.names())}")
        return self._known[name](*args, **kwargs)


SOURCES, VIEWS = Registry(), Registry()


def search_all(spark: SparkSession, query: str, limit: int = 5, names: list[str] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(union of the sources' rows, [(name, state)]): a source that fails is a state, not an exception."""
    from functools import reduce

    found, states = [], []
    for name in names or SOURCES.names():
        try:
            found.append(SOURCES(name, spark, query, limit))
            states.append((name, "started"))
        except Exception as error:  # noqa: BLE001
            states.append((name, f"failed: {type(error).__name__}"))
    if not found:
        return spark.createDataFrame([], "source string, source_id string, url string, title string, content string, date timestamp"), states
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), states
