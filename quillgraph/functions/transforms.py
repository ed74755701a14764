"""Named pure functions for mappings and computed Things. A function is a Column expression first; an opaque Python one is
wrapped as a vectorized UDF. Functions may call others by name; a missing name or a call too deep is an error when the
plan is built, never at run time."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.json_text import number_of, quoted, string_of

DEPTH = 32


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, Callable[..., Column]] = {
            "upper": lambda x: quoted(F.upper(string_of(x))),
            "lower": lambda x: quoted(F.lower(string_of(x))),
            "trim": lambda x: quoted(F.trim(string_of(x))),
            "to_number": lambda x: F.coalesce(number_of(x), string_of(x).try_cast("double")).cast("string"),
            "to_text": lambda x: F.when(F.lit(True), quoted(F.coalesce(string_of(x), x))),
        }
        self.depth = 0

    def __contains__(self, name: str) -> bool:
        return name in self.functions

    def register(self, name: str, function: Callable[..., Column], required: tuple[str, ...] = ()) -> None:
        """function takes Columns of JSON text (and `call`, to use other functions) and gives one."""

        def checked(*args: Column, **named: Column) -> Column:
            missing = [p for p in required if p not in named]
            if missing:
                raise ValueError(f"{name}: {', '.join(missing)} missing")
            return function(*args, **named)

        self.functions[name] = checked

    def register_python(self, name: str, function: Callable[[str | None], str | None]) -> None:
        """An opaque function of one JSON text, run over Arrow batches; what raises gives NULL."""

        def safe(x: str | None) -> str | None:
            try:
                return None if x is None else function(x)
            except Exception:  # noqa: BLE001 - a transform's failure is an error row, not a failed job
                return None

        @F.pandas_udf("string")
        def batched(values: pd.Series) -> pd.Series:
            return values.map(safe)

        self.functions[name] = lambda x: batched(x)

    def call(self, name: str, *args: Column, **named: Column) -> Column:
        if name not in self.functions:
            raise KeyError(f"unknown function {name}")
        if self.depth >= DEPTH:
            raise RecursionError(f"{name}: more than {DEPTH} calls deep")
        self.depth += 1
        try:
            return self.functions[name](*args, **named)
        finally:
            self.depth -= 1
