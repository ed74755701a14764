"""Mapping paths, compiled to columns over a JSON record.

A path is $ (the record), $.a.b or a.b, a number, a quoted string, true, false or null. Values are JSON text: SQL NULL is
what the path doesn't reach, the text 'null' is JSON's null.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = re.compile(r"-?\d+(\.\d+)?\Z")


def value_at(record: Column, path: str) -> Column:
    """JSON text of the value at `path` of a VARIANT column."""
    path = path.strip()
    if path in ("true", "false", "null") or _NUMBER.match(path):
        return F.lit(path)
    if len(path) > 1 and path[0] == path[-1] and path[0] in "\"'":
        return F.lit(json.dumps(path[1:-1], ensure_ascii=False))
    inner = path.removeprefix("$").removeprefix(".")
    if not inner:
        return F.to_json(record)
    steps = "".join(f"[{json.dumps(step)}]" if not re.match(r"[A-Za-z_]\w*\Z", step) else f".{step}" for step in inner.split("."))
    return F.to_json(F.try_variant_get(record, f"${steps}", "variant"))


def is_path(path: str) -> bool:
    """Whether a path leads into the record, rather than being a constant."""
    path = path.strip()
    return not (path in ("true", "false", "null") or _NUMBER.match(path) or path[:1] in "\"'")


def variant_at(record: Column, path: str | None) -> Column:
    if path is None or path.strip() == "$":
        return record
    inner = path.strip().removeprefix("$").removeprefix(".")
    return F.try_variant_get(record, f"$.{inner}", "variant")
