"""Providers as adapters: what a provider's log lines say of usage, sessions, prompts and transcripts, by name (UDF-1, UDF-2).

Every function takes lines (path, line_no, raw) and gives a relation; another provider is registered with its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerloom.operators import extraction as X
from ledgerloom.operators import history as Y


@dataclass(frozen=True)
class Adapter:
    name: str
    events: Callable[[DataFrame], DataFrame]
    sessions: Callable[[DataFrame], DataFrame]
    prompts: Callable[[DataFrame, bool], DataFrame]
    transcript: Callable[[DataFrame], DataFrame]


def _events_b(lines: DataFrame) -> DataFrame:
    return X.events_b(X.progressive(X.candidates_b(lines), "message_id", ["path", "line_no"]))


ADAPTERS: dict[str, Adapter] = {
    a.name: a
    for a in (
        Adapter("codex", X.events_a, lambda lines: Y.sessions_a(lines).drop("identity"), Y.prompts_a, Y.transcript_a),
        Adapter("claude", _events_b, Y.sessions_b, Y.prompts_b, Y.transcript_b),
    )
}


def register(adapter: Adapter) -> None:
    """Adds a provider; a name stands for one adapter only."""
    if adapter.name in ADAPTERS:
        raise ValueError(f"{adapter.name} is registered")
    ADAPTERS[adapter.name] = adapter


def adapter(name: str) -> Adapter:
    if name not in ADAPTERS:
        raise ValueError(f"no adapter for {name}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


def events(logs: dict[str, DataFrame]) -> DataFrame:
    """Usage events of several providers' lines in one relation (X.EVENT)."""
    out = None
    for name, lines in logs.items():
        one = adapter(name).events(lines).select(*X.EVENT)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no logs are given")
    return out
