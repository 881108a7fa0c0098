"""Scalar functions that users add: for models (over numpy arrays) and for queries (over term Columns)."""

from __future__ import annotations

from collections.abc import Callable

MODEL: dict[str, Callable] = {}
QUERY: dict[str, Callable] = {}


def register_builtin(name: str, f: Callable) -> None:
    """A function for models' expressions; it gets and gives numbers or numpy arrays over runs."""
    MODEL[name] = f


def register_query_function(name: str, f: Callable) -> None:
    """A function for graph queries; it gets and gives term Columns."""
    QUERY[name.upper()] = f


def unregister(name: str) -> None:
    MODEL.pop(name, None)
    QUERY.pop(name.upper(), None)
