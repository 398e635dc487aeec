"""Property filters written as plain dictionaries.

``{"level": "HIGH", "rpn": {"$gt": 100, "$lte": 300}, "description": {"$contains": "fall"}}``
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$contains": lambda c, v: F.lower(c).contains(F.lower(F.lit(v))),
    "$in": lambda c, v: c.isin(list(v)),
}


def matches(filters: Mapping[str, object] | None) -> Column:
    """All conditions of ``filters`` as one predicate (true when empty)."""
    conditions = []
    for name, wanted in (filters or {}).items():
        if isinstance(wanted, Mapping):
            for operator, value in wanted.items():
                if operator not in OPERATORS:
                    raise ValueError(f"Unknown filter operator: {operator}")
                conditions.append(OPERATORS[operator](F.col(name), value))
        elif isinstance(wanted, (list, tuple, set)):
            conditions.append(F.col(name).isin(list(wanted)))
        else:
            conditions.append(F.col(name) == wanted)
    return reduce(and_, conditions, F.lit(True))
