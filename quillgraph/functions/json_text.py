"""Fields are kept as JSON text: a missing key is SQL NULL, JSON null is the text 'null', strings keep their quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(name: str, fields: str = "fields") -> Column:
    return F.element_at(F.col(fields), F.lit(name))


def quoted(value: Column) -> Column:
    """JSON text of a string column (null stays missing)."""
    return F.when(value.isNotNull(), F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"')))


def is_string(text: Column) -> Column:
    return F.coalesce(text.startswith('"'), F.lit(False))


def string_of(text: Column) -> Column:
    """The value of a JSON string, NULL for other types."""
    return F.when(is_string(text), F.get_json_object(text, "$"))


def number_of(text: Column) -> Column:
    """The value of a JSON number, NULL for other types."""
    return F.when(~is_string(text), text.try_cast("double"))


def loose_string(text: Column) -> Column:
    """Any value as text, missing and null as ''."""
    return F.when(text.isNull() | (text == "null"), F.lit("")).otherwise(F.coalesce(string_of(text), text))


def is_blank(text: Column) -> Column:
    """Missing, null, an empty list or a string of white space."""
    return text.isNull() | text.isin("null", "[]") | F.coalesce(F.trim(string_of(text)) == "", F.lit(False))


def truthy(text: Column) -> Column:
    """JavaScript's notion: missing, null, false, 0 and '' are false."""
    return ~(text.isNull() | text.isin("null", "false", '""') | F.coalesce(number_of(text) == 0, F.lit(False)))
