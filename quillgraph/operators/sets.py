"""Set algebra over a model: base sets, filters, set operations and aggregates.

A set is a DataFrame (map_id, id); a filter is a boolean Column over an entity's fields that is never NULL, so that `not`
is two-valued. Everything is lazy; filters and columns reach the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.json_text import field, is_string, loose_string, number_of, string_of
from quillgraph.functions.vocab import FACETS, PREDICATES

KEY = ["map_id", "id"]


def ids(df: DataFrame) -> DataFrame:
    return df.select("map_id", F.col("uri").alias("id"))


# Base sets.
def base(model, kind: str) -> DataFrame:
    """All ids of a class or facet key; Context is sub-contexts without the root; unknown kinds give the empty set."""
    name = FACETS.get(kind, kind)
    if name in ("Context", "contexts"):
        return ids(model.contexts.where("parent_uri is not null"))
    if name in ("Symbol", "symbols"):
        return ids(model.symbols)
    return ids(model.entities.where((F.col("class_id") == name) & ~F.col("is_custom")))


def in_context(model, container: str) -> DataFrame:
    """Facets and symbols of one container, not its children."""
    both = model.entities.where("not is_custom").unionByName(model.symbols)
    return ids(both.where(F.col("container_uri") == container))


def tagged(model, tag: str) -> DataFrame:
    """Contexts (not the root), facets and symbols that carry a tag."""
    has = F.array_contains("tags", tag)
    return ids(model.contexts.where(F.col("parent_uri").isNotNull() & has)).unionByName(ids(model.entities.where(has & ~F.col("is_custom")))).unionByName(ids(model.symbols.where(has)))


def with_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the wanted ids that exist among rows (uri)."""
    return rows.join(wanted.select("map_id", F.col("id").alias("uri")).distinct(), ["map_id", "uri"], "left_semi").select("map_id", F.col("uri").alias("id"))


# Filters.
def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def compare(name: str, op: str, value) -> Column:
    """eq and neq are strict in type and value (a missing field is unequal to anything); the others compare numbers if
    both are, else strings, with null as ''."""
    text = field(name)
    if op in ("eq", "neq"):
        if value is None:
            same = sure(text == "null")
        elif isinstance(value, bool):
            same = sure(text == ("true" if value else "false"))
        elif isinstance(value, str):
            same = sure(string_of(text) == value)
        else:
            same = sure(number_of(text) == float(value))
        return same if op == "eq" else ~same
    test = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[op]
    as_text = test(loose_string(text), F.lit(str(value)))
    if isinstance(value, str):
        return sure(as_text)
    return sure(F.when(number_of(text).isNotNull(), test(number_of(text), F.lit(float(value)))).otherwise(as_text))


def text_test(name: str, op: str, value: str) -> Column:
    """contains, startsWith and regex (unanchored); false for what isn't a string."""
    text = string_of(field(name))
    test = {"contains": text.contains, "startsWith": text.startswith, "regex": text.rlike}[op]
    return is_string(field(name)) & sure(test(value))


def one_of(name: str, values: list) -> Column:
    """Equal to one of the values, in type and value: one list per JSON type, however many there are."""
    text, tests = field(name), []
    strings, numbers = [v for v in values if isinstance(v, str)], [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    plain = [{None: "null", True: "true", False: "false"}[v] for v in values if v is None or isinstance(v, bool)]
    for some, column in ((strings, string_of(text)), (numbers, number_of(text)), (plain, text)):
        if some:
            tests.append(sure(column.isin(some)))
    return any_of(*tests)


def is_null(name: str) -> Column:
    return sure(field(name).isNull() | (field(name) == "null"))


def all_of(*filters: Column) -> Column:
    return reduce(lambda a, b: a & b, filters, F.lit(True))


def any_of(*filters: Column) -> Column:
    return reduce(lambda a, b: a | b, filters, F.lit(False))


def has_tag(tag: str) -> Column:
    return sure(F.array_contains("tags", tag))


def has_kind(kind: str) -> Column:
    """Stereotype, personaType or measureType."""
    return any_of(*[compare(name, "eq", kind) for name in ("stereotype", "personaType", "measureType")])


def facet_count(model, kind: str, op: str, n: int) -> DataFrame:
    """Contexts by the number of their facets of a kind (a context without any counts 0)."""
    name = FACETS.get(kind, kind)
    counts = model.entities.where((F.col("class_id") == name) & ~F.col("is_custom")).groupBy("map_id", F.col("container_uri").alias("uri")).agg(F.count(F.lit(1)).alias("n"))
    held = model.contexts.where("parent_uri is not null").join(counts, ["map_id", "uri"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    test = {"eq": F.col("n") == n, "gt": F.col("n") > n, "lt": F.col("n") < n, "gte": F.col("n") >= n, "lte": F.col("n") <= n}[op]
    return held.where(test).select("map_id", F.col("uri").alias("id"), "n")


def runtime_compare(name: str, op: str, value) -> Column:
    """The filters on instance attributes, with JavaScript's coercion: text tests read any value as text, order tests
    read null as 0 and text as a number where it is one; a missing attribute fails order tests."""
    text = F.element_at("attributes", F.lit(name))["value"]
    if op in ("contains", "startsWith", "regex"):
        plain = loose_string(text)
        return sure({"contains": plain.contains, "startsWith": plain.startswith, "regex": plain.rlike}[op](value))
    if op in ("eq", "neq"):
        same = sure(string_of(text) == value) if isinstance(value, str) else sure(number_of(text) == float(value))
        return same if op == "eq" else ~same
    if op in ("isNull", "isNotNull"):
        empty = sure(text.isNull() | (text == "null"))
        return empty if op == "isNull" else ~empty
    number = F.when(text == "null", F.lit(0.0)).when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(loose_string(text).try_cast("double"))
    return sure({"gt": number > value, "gte": number >= value, "lt": number < value, "lte": number <= value}[op])


def where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(condition)


# Set operations.
def union(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets).dropDuplicates(KEY)


def intersect(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, KEY, "left_semi"), sets).dropDuplicates(KEY)


def subtract(start: DataFrame, minus: DataFrame) -> DataFrame:
    return start.dropDuplicates(KEY).join(minus, KEY, "left_anti")


# Aggregates over entities of a set.
def aggregate(rows: DataFrame, op: str, name: str | None = None, by: str | None = None) -> DataFrame:
    """count, countDistinct (JSON values; missing ones don't count), sum, avg, min or max of a field (numbers only, 0 if
    there are none), per value of `by` (missing and null are 'unknown')."""
    if op == "count":
        value = F.count(F.lit(1)).cast("double")
    elif op == "countDistinct":
        value = F.count_distinct(field(name)).cast("double")
    else:
        value = F.coalesce({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](number_of(field(name))), F.lit(0.0))
    if by is None:
        return rows.agg(value.alias("value"))
    text = field(by)
    group = F.when(text.isNull() | (text == "null"), F.lit("unknown")).otherwise(F.coalesce(string_of(text), text))
    return rows.groupBy(group.alias("group")).agg(value.alias("value"))


class Query:
    """A chain of set operations over one model: every step gives a new, lazy query.

    A query knows its ids and, while no walk or set operation has come between, its entity rows: filters on a base set then
    are filters on its tables. After a walk the entity rows are joined with the distinct ids once; an inner join, for
    Spark would copy a semi join, with all that led to its ids, into each of the classes' tables. Only the classes that the
    walk's predicate may reach are read (`reach`); links to others are faults that joins.validate_links lists.
    """

    def __init__(self, model, rows: DataFrame | None, known: DataFrame | None = None, reach: frozenset[str] | None = None) -> None:
        self.model, self.known, self.reach = model, known, reach
        self.rows = ids(known) if rows is None else rows

    @classmethod
    def of(cls, model, kind: str) -> Query:
        name = FACETS.get(kind, kind)
        if name in ("Context", "contexts"):
            return cls(model, base(model, kind))
        if name in ("Symbol", "symbols"):
            return cls(model, None, model.symbols)
        return cls(model, None, model.entities.where((F.col("class_id") == name) & ~F.col("is_custom")))

    def entities(self) -> DataFrame:
        if self.known is not None:
            return self.known
        rows = self.model.entities
        if self.reach is None or "Symbol" in self.reach:
            rows = rows.unionByName(self.model.symbols)
        if self.reach is not None:
            rows = rows.where(F.col("class_id").isin(sorted(self.reach)) | F.col("is_custom"))
        wanted = self.rows.select("map_id", F.col("id").alias("uri")).distinct()
        return rows.join(wanted, ["map_id", "uri"])

    def where(self, conditions: dict) -> Query:
        """{field: value or {operator: value, ...}}; all of them must hold, a null value means missing or null."""
        tests = []
        for name, wanted in conditions.items():
            for op, value in wanted.items() if isinstance(wanted, dict) else [("eq", wanted)]:
                if value is None:
                    tests.append(is_null(name))
                elif op in ("contains", "startsWith", "regex"):
                    tests.append(text_test(name, op, value))
                elif op == "in":
                    tests.append(one_of(name, value))
                else:
                    tests.append(compare(name, op, value))
        return Query(self.model, None, self.entities().where(all_of(*tests)), self.reach)

    def traverse(self, predicate: str = "*", direction: str = "out", depth: int = 1) -> Query:
        from quillgraph.operators.graph import traverse

        return Query(self.model, traverse(self.rows, self.model.links, predicate, direction, depth).select(*KEY), None, reached(predicate, direction))

    def _with(self, rows: DataFrame, other: Query) -> Query:
        reach = None if self.reach is None or other.reach is None else self.reach | other.reach
        return Query(self.model, rows, None, reach)

    def union(self, other: Query) -> Query:
        return self._with(union(self.rows, other.rows), other)

    def intersect(self, other: Query) -> Query:
        return Query(self.model, intersect(self.rows, other.rows), None, self.reach)

    def subtract(self, other: Query) -> Query:
        return Query(self.model, subtract(self.rows, other.rows), None, self.reach)

    def aggregate(self, op: str, name: str | None = None, by: str | None = None) -> DataFrame:
        return aggregate(self.entities(), op, name, by)


def reached(predicate: str, direction: str) -> frozenset[str] | None:
    """The classes that a walk over a predicate may end at; None: any."""
    for name, domain, ends, _ in PREDICATES:
        if name == predicate:
            return frozenset({"out": ends, "in": domain}.get(direction, f"{domain} {ends}").split())
    return None


def find_by_thing(instances: DataFrame, thing: str) -> DataFrame:
    """The instances of one Thing."""
    return instances.where(F.col("thing_id") == thing)


def find_by_id(instances: DataFrame, thing: str, key: str) -> DataFrame:
    """The instance of a Thing with one id."""
    return find_by_thing(instances, thing).where(F.col("id") == key)


def searchable(model) -> DataFrame:
    """map_id, uri, class_id, container_uri, name, searched (in lower case), snippet of entities, symbols and contexts: an
    entity's name, definition, description, role, attribute names and rules, a symbol's label and content, a context's name
    and description."""
    text = lambda n: F.nullif(loose_string(field(n)), F.lit(""))
    names = F.array_join(F.from_json(field("attributes"), "array<struct<name: string>>")["name"], " ")
    rules = F.array_join(F.from_json(field("rules"), "array<string>"), " ")
    places = ["map_id", "uri", "class_id", "container_uri"]
    words = F.concat_ws(" ", "name", text("definition"), text("description"), text("role"), F.nullif(names, F.lit("")), F.nullif(rules, F.lit("")))
    entities = model.entities.where("not is_custom").select(*places, "name", words.alias("searched"), F.coalesce(text("definition"), text("description"), text("role"), F.lit("")).alias("snippet"))
    said = text("content")
    symbols = model.symbols.select(*places, F.coalesce(text("label"), F.substring(said, 1, 80), F.lit("")).alias("name"), F.concat_ws(" ", text("label"), said).alias("searched"), F.coalesce(said, F.lit("")).alias("snippet"))
    contexts = model.contexts.where("parent_uri is not null").select("map_id", "uri", F.lit("Context").alias("class_id"), F.col("parent_uri").alias("container_uri"), "name", F.concat_ws("\n", "name", text("description")).alias("searched"), F.coalesce(text("description"), F.lit("")).alias("snippet"))
    return entities.unionByName(symbols).unionByName(contexts).withColumns({"searched": F.lower("searched"), "snippet": F.substring("snippet", 1, 100)})


def found(hits: DataFrame, text: str, contexts: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Those of searchable rows that hold `text` in any case: id, name, class, container's name, snippet."""
    hits = hits if classes is None else hits.where(F.col("class_id").isin(classes))
    names = contexts.select("map_id", F.col("uri").alias("container_uri"), F.col("name").alias("context_name"))
    return hits.where(F.col("searched").contains(text.lower())).join(names, ["map_id", "container_uri"], "left").select("map_id", F.col("uri").alias("id"), "name", "class_id", "context_name", "snippet")


def search(model, text: str, classes: list[str] | None = None) -> DataFrame:
    """What holds `text`, by a scan (operators/search.py: by an index)."""
    return found(searchable(model), text, model.contexts, classes)

