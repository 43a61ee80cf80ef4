"""Engines by (source, subject).

An engine turns one source's unpacked rows into a star table's shape.  New sources
plug in with ``register_engine``; the factories look engines up here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Engine = Callable[..., DataFrame]

_ENGINES: dict[tuple[str, str], Engine] = {}


def register_engine(source: str, subject: str, fn: Engine | None = None):
    """Register directly, or use as a decorator."""
    if fn is not None:
        _ENGINES[(source, subject)] = fn
        return fn

    def decorate(inner: Engine) -> Engine:
        _ENGINES[(source, subject)] = inner
        return inner

    return decorate


def engine(source: str, subject: str) -> Engine:
    try:
        return _ENGINES[(source, subject)]
    except KeyError:
        raise ValueError(f"no engine for source '{source}' and subject '{subject}'") from None


def sources_for(subject: str) -> tuple[str, ...]:
    return tuple(source for source, kind in _ENGINES if kind == subject)
