"""Compiling filter dictionaries into predicates.

``{"doc_id": "x"}``, ``{"year": {"$gte": 2020}}``, ``{"$and": [...]}`` on columns; ``{"$contains": "text"}`` on content. A predicate is a
plain Column, so Catalyst pushes it to the scan. A comparison with a null column is not true.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def where(spec: Mapping[str, Any] | None) -> Column:
    """The predicate of a metadata filter; an empty or missing filter is true."""
    if not spec:
        return F.lit(True)
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            if not value:
                raise ValueError(f"{key} needs at least one filter")
            parts.append(reduce(and_ if key == "$and" else or_, [where(v) for v in value]))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key!r}")
        elif isinstance(value, Mapping):
            for op, operand in value.items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown operator {op!r}")
                parts.append(_COMPARE[op](F.col(key), operand))
        else:
            parts.append(F.col(key) == value)
    return reduce(and_, parts)


def where_document(spec: Mapping[str, Any] | None, content: str = "content") -> Column:
    """The predicate of a content filter; case matters."""
    if not spec:
        return F.lit(True)
    parts = []
    for op, value in spec.items():
        if op == "$contains":
            parts.append(F.col(content).contains(value))
        elif op == "$not_contains":
            parts.append(~F.col(content).contains(value))
        elif op in ("$and", "$or"):
            parts.append(reduce(and_ if op == "$and" else or_, [where_document(v, content) for v in value]))
        else:
            raise ValueError(f"unknown operator {op!r}")
    return reduce(and_, parts)
