"""Keyset pages and their cursors (SRT-4..9, SRT-10, SRT-16)."""

from __future__ import annotations

import base64
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode_cursor(values: list[Any], filters: str, generation: int) -> str:
    """v1: and base64url of the last row's keys, bound to the filters and to the generation of the data."""
    raw = json.dumps({"k": values, "f": filters, "g": generation}, separators=(",", ":")).encode()
    return "v1:" + base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str, filters: str, generation: int) -> list[Any]:
    if not cursor.startswith("v1:"):
        raise ValueError("unknown cursor")
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor[3:] + "=" * (-len(cursor[3:]) % 4)))
        keys, of, at = found["k"], found["f"], found["g"]
    except (ValueError, KeyError, TypeError) as broken:
        raise ValueError("broken cursor") from broken
    if of != filters or at != generation:
        raise ValueError("the cursor belongs to another query or state")
    return keys


def after(keys: list[tuple[str, bool]], last: list[Any]) -> Column:
    """Rows past the last one, of values or columns, in the order of keys (column, descending); a null key stands last, in either direction (SRT-4)."""
    out, equal = F.lit(False), F.lit(True)
    for (name, down), value in zip(keys, last):
        c = F.col(name)
        if value is None:
            beyond = F.lit(False)  # nothing is past unknown but by the keys that follow
            same = c.isNull()
        elif isinstance(value, Column):
            beyond = value.isNotNull() & (c.isNull() | ((c < value) if down else (c > value)))
            same = c.eqNullSafe(value)
        else:
            beyond = c.isNull() | ((c < value) if down else (c > value))
            same = c == value
        out = out | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & F.coalesce(same, F.lit(False))
    return out


def beyond(rows: DataFrame, keys: list[tuple[str, bool]], keep: int) -> DataFrame:
    """The rows after the first `keep` in the order of keys (column, descending): what a retention of so many would remove (SRT-10).

    The keys name each row; the rows kept are a bounded top-n, and the others are found by an anti-join with them.
    """
    first = rows.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]).limit(keep).select(*[c for c, _ in keys])
    return rows.join(F.broadcast(first), [c for c, _ in keys], "left_anti")


def page(rows: DataFrame, keys: list[tuple[str, bool]], size: int, last: list[Any] | None = None) -> DataFrame:
    """One page and a row to look ahead: a seek predicate and a bounded top-n."""
    if not 1 <= size <= 500:
        raise ValueError("a page has 1 to 500 rows")
    found = rows.filter(after(keys, last)) if last is not None else rows
    return found.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]).limit(size + 1)
