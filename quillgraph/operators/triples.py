"""Triples of models, instances and runtime data, and their RDF forms. Unions of narrow projections; only grouping forms shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.json_text import field, loose_string, string_of
from quillgraph.operators.scan import RANGE, in_ranges

NS = "https://quillgraph.example/"


def triple(rows: DataFrame, s, p, o) -> DataFrame:
    column = lambda x: x if isinstance(x, Column) else F.col(x)
    made = rows.select(column(s).alias("s"), (p if isinstance(p, Column) else F.lit(p)).alias("p"), column(o).alias("o"))
    return made.where("s is not null and o is not null")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


ATTRIBUTES = "array<struct<name: string, type: string, referencedThingId: string>>"


def attributes_of(things: DataFrame) -> DataFrame:
    """thing, name, type, target of the attributes that Things declare."""
    rows = things.select(F.col("uri").alias("thing"), F.explode(F.from_json(field("attributes"), ATTRIBUTES)).alias("a"))
    return rows.select("thing", F.col("a.name").alias("name"), F.col("a.type").alias("type"), F.col("a.referencedThingId").alias("target"))


def reference_triples(attributes: DataFrame) -> DataFrame:
    return triple(attributes.where("type = 'reference' and target != ''"), "thing", "references", "target")


def inherited_triples(extends: DataFrame, things: DataFrame, attributes: DataFrame) -> DataFrame:
    """For every extends link (source_uri, target_uri) between Things (uri) the parent's attributes (thing, name, type) whose
    names the child lacks, as name:type:parent."""
    child = extends.select(F.col("source_uri").alias("s"), F.col("target_uri").alias("thing")).join(things.select(F.col("uri").alias("s")).distinct(), "s")
    theirs = child.join(attributes.select("thing", "name", "type"), "thing")
    own = attributes.select(F.col("thing").alias("s"), "name").distinct()
    return triple(theirs.join(own, ["s", "name"], "left_anti"), "s", "inheritedAttribute", F.concat_ws(":", "name", "type", "thing"))


def model_triples(model, symbols: bool = False) -> DataFrame:
    """Types, labels, places, tags and links of a model; references of Things and attributes inherited over one step of extends."""
    entities = model.entities.unionByName(model.symbols) if symbols else model.entities
    contexts = model.contexts
    things = model.entities.where("class_id = 'Thing' and not is_custom")
    attributes = attributes_of(things)
    label = F.coalesce("name", string_of(field("label")), F.substring(string_of(field("content")), 1, 80))
    tags = entities.select("uri", "tags").unionByName(contexts.select("uri", "tags"))
    return union(
        triple(contexts, "uri", "rdf:type", F.lit("bm:Context")),
        triple(contexts, "uri", "rdfs:label", "name"),
        triple(contexts, "uri", "childOf", "parent_uri"),
        triple(entities, "uri", "rdf:type", F.concat(F.lit("bm:"), "class_id")),
        triple(entities, "uri", "rdfs:label", label),
        triple(entities, "uri", "memberOf", "container_uri"),
        triple(tags.select("uri", F.explode("tags").alias("tag")), "uri", "hasTag", "tag"),
        triple(model.links, "source_uri", F.col("predicate"), "target_uri"),
        reference_triples(attributes),
        inherited_triples(model.links.where("predicate = 'extends'"), things, attributes),
    )


STEPS = "array<struct<id: string, name: string>>"
STATES = "array<struct<id: string, name: string, transitions: array<struct<targetStateId: string>>>>"
DERIVED = "array<struct<sourceThingId: string>>"


def document_triples(flat: dict[str, DataFrame]) -> DataFrame:
    """All triples of whole documents (as documents.flatten gives them): types, labels, places and tags of facets, symbols and
    facets of declared kinds; steps of workflows, whom and what these involve, states of Things and where they lead, where
    payloads and schemas come from, mentions in notes, references, attributes inherited over one step, and the links."""
    containers, links = flat["containers"], flat["links"]
    own = flat["entities"].where("not is_custom")
    custom = flat["entities"].where("is_custom").join(flat["kinds"].select("map_id", F.col("plural_key").alias("facet_key")).distinct(), ["map_id", "facet_key"], "left_semi")
    rows = own.withColumn("_type", F.concat(F.lit("bm:"), "class_id")).unionByName(custom.withColumn("_type", F.concat(F.lit("bm:custom/"), "class_id")))
    note = F.coalesce(string_of(field("label")), F.substring(string_of(field("content")), 1, 100))
    label = F.when(F.col("class_id") == "Symbol", note).otherwise(F.coalesce("name", "uri"))
    tags = rows.select("uri", "tags").unionByName(containers.select("uri", "tags"))
    nested = lambda name, kind: own.select("uri", "class_id", F.explode(F.from_json(field(name), kind)).alias("x"))
    steps, states = nested("steps", STEPS).where("class_id = 'Workflow'"), nested("states", STATES).where("class_id = 'Thing'")
    moves = states.select(F.col("x.id").alias("id"), F.explode("x.transitions").alias("t"))
    derived = [triple(nested(n, DERIVED), "uri", "derivedPayloadFrom", F.nullif(F.col("x.sourceThingId"), F.lit(""))) for n in ("payload", "requestSchema", "responseSchema")]
    said = own.where("class_id = 'Symbol'").select("uri", F.explode(F.regexp_extract_all(string_of(field("content")), F.lit(r"@\[[^\]]*\]\(entity:([^)]+)\)"), F.lit(1))).alias("id"))
    of_step = steps.select(F.col("x.id").alias("source_uri"), F.col("uri").alias("workflow")).distinct()
    involved = lambda link, name: triple(links.where(F.col("predicate") == link).join(of_step, "source_uri").select("workflow", "target_uri").distinct(), "workflow", name, "target_uri")
    things = own.where("class_id = 'Thing'")
    attributes = attributes_of(things)
    return union(
        triple(containers, "uri", "rdf:type", F.lit("bm:Context")),
        triple(containers, "uri", "rdfs:label", "name"),
        triple(containers, "uri", "childOf", "parent_uri"),
        triple(rows, "uri", "rdf:type", "_type"),
        triple(rows, "uri", "memberOf", "container_uri"),
        triple(rows, "uri", "rdfs:label", label),
        triple(tags.select("uri", F.explode("tags").alias("tag")), "uri", "hasTag", "tag"),
        *derived,
        triple(steps, "x.id", "rdf:type", F.lit("bm:WorkflowStep")),
        triple(steps, "x.id", "memberOf", "uri"),
        triple(steps, "x.id", "rdfs:label", F.coalesce("x.name", "x.id")),
        triple(states, "x.id", "rdf:type", F.lit("bm:ThingState")),
        triple(states, "x.id", "state:memberOf", "uri"),
        triple(states, "x.id", "rdfs:label", "x.name"),
        triple(moves, "id", "state:transitionsTo", "t.targetStateId"),
        involved("step:performer", "workflow:involvesPersona"),
        involved("step:action", "workflow:involvesAction"),
        triple(said, "uri", "mentions", "id"),
        reference_triples(attributes),
        inherited_triples(links.where("predicate = 'extends'"), things, attributes),
        triple(links, "source_uri", F.col("predicate"), "target_uri"),
    )


def workflow_triples(steps: DataFrame) -> DataFrame:
    """steps: workflow, performer, action; a persona or action counts once per workflow."""
    return union(triple(steps.select("workflow", "performer").distinct(), "workflow", "workflow:involvesPersona", "performer"), triple(steps.select("workflow", "action").distinct(), "workflow", "workflow:involvesAction", "action"))


def instance_triples(instances: DataFrame, relationships: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """Typed records with their attributes (JSON null as 'null'), relationships, and measured points."""
    attributes = instances.select("id", F.explode("attributes").alias("name", "a"))
    parts = [
        triple(instances, "id", "rdf:type", F.lit("bm:EntityInstance")),
        triple(instances, "id", "instanceOf", "thing_id"),
        triple(instances, "id", "createdAt", F.col("created_at").cast("string")),
        triple(instances, "id", "inContext", "context_id"),
        triple(attributes, "id", F.concat(F.lit("attr/"), "name"), F.coalesce(string_of(F.col("a.value")), F.col("a.value"))),
        triple(relationships, "source_id", F.col("predicate"), "target_id"),
    ]
    if measures is not None:
        parts.append(measure_triples(measures))
    return union(*parts)


def occurrence_triples(events: DataFrame) -> DataFrame:
    """Events that happened (id, event_id, occurred_at, source_action_id)."""
    rows = events.withColumn("s", F.concat(F.lit("event-occurrence/"), F.col("id").cast("string")))
    return union(triple(rows, "s", "rdf:type", F.lit("bm:EventOccurrence")), triple(rows, "s", "instanceOf", "event_id"), triple(rows, "s", "occurredAt", F.col("occurred_at").cast("string")), triple(rows, "s", "triggeredBy", F.nullif(F.col("source_action_id"), F.lit(""))))


def measure_triples(measures: DataFrame) -> DataFrame:
    """Measured points (measure_id, ts, value, dimensions map<string,string>); a point's name is its measure and time."""
    rows = measures.withColumn("s", F.concat_ws("/", F.lit("measure-point"), "measure_id", F.col("ts").cast("string")))
    dimensions = rows.select("s", F.explode("dimensions").alias("k", "v"))
    return union(
        triple(rows, "s", "rdf:type", F.lit("bm:MeasureDataPoint")), triple(rows, "s", "measureOf", "measure_id"), triple(rows, "s", "value", F.col("value").cast("string")),
        triple(rows, "s", "timestamp", F.col("ts").cast("string")), triple(dimensions, "s", F.concat(F.lit("dimension/"), "k"), "v"),
    )


def runtime_triples(instances: DataFrame, runs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """instances: uri, type_uri, data, run; runs: uri, pipeline; marks: uri, p, o (retried, suppressed, replayed, ...)."""
    label = loose_string(F.coalesce(F.element_at("data", "name"), F.element_at("data", "label")))
    parts = [
        triple(instances, "uri", "rdf:type", "type_uri"),
        triple(instances, "uri", "rdfs:label", F.nullif(label, F.lit(""))),
        triple(instances, "uri", "producedBy", "run"),
        triple(runs, "uri", "runFor", "pipeline"),
    ]
    return union(*parts, *([marks.select("s", "p", "o")] if marks is not None else []))


# RDF text.
def iri_encode(text: Column) -> Column:
    """Percent-encoding of everything but letters, digits and - _ . ! ~ * ' ( )."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def literal(text: Column) -> Column:
    out = text
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def resource(text: Column) -> Column:
    return F.concat(F.lit(f"<{NS}entity/"), iri_encode(text), F.lit(">"))


def property_name(p: Column) -> Column:
    """A predicate as an IRI; only the first colon becomes an underscore."""
    return F.when(p == "rdf:type", F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>")).when(p == "rdfs:label", F.lit("<http://www.w3.org/2000/01/rdf-schema#label>")).otherwise(F.concat(F.lit(f"<{NS}vocab/"), F.regexp_replace(p, "^([^:]*):", "$1_"), F.lit(">")))


def object_term(p: Column, o: Column, instance: bool = False) -> Column:
    if instance:
        return F.when(o.startswith("http"), F.concat(F.lit("<"), o, F.lit(">"))).otherwise(literal(o))
    return F.when(p == "rdfs:label", literal(o)).when(p == "rdf:type", F.concat(F.lit(f"<{NS}vocab/"), F.regexp_replace(o, "^bm:", ""), F.lit(">"))).otherwise(resource(o))


def ntriples(triples: DataFrame, instance: bool = False) -> DataFrame:
    """value: one line per triple; no shuffle."""
    return triples.select(F.concat_ws(" ", resource(F.col("s")), property_name(F.col("p")), object_term(F.col("p"), F.col("o"), instance), F.lit(".")).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """s, value: one block per subject, its triples in order of predicate and object; a hub's block is as long as its
    triples, which is the format's own demand."""
    name = F.when(F.col("p") == "rdf:type", "a").otherwise(property_name(F.col("p")))
    rows = triples.select("s", F.struct(F.when(F.col("p") == "rdf:type", 0).otherwise(1).alias("first"), "p", "o", F.concat_ws(" ", name, object_term(F.col("p"), F.col("o"))).alias("text")).alias("t"))
    grouped = rows.groupBy("s").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("s", F.concat(resource(F.col("s")), F.lit(" "), F.array_join(F.transform("t", lambda t: t["text"]), " ;\n  "), F.lit(" .")).alias("value"))


def jsonld(triples: DataFrame) -> DataFrame:
    """s, value: one node per subject; several objects of a predicate become a list, of several types the last counts."""
    objects = triples.groupBy("s", "p").agg(F.sort_array(F.collect_list("o")).alias("o"))
    types = objects.where("p = 'rdf:type'").select("s", F.element_at("o", -1).alias("type"))
    rest = objects.where("p != 'rdf:type'").select("s", F.struct("p", F.to_json("o").alias("j"), F.size("o").alias("n")).alias("e"))
    text = lambda e: F.concat(F.lit('"'), e["p"], F.lit('":'), F.when(e["n"] == 1, F.regexp_replace(e["j"], r"^\[|\]$", "")).otherwise(e["j"]))
    nodes = rest.groupBy("s").agg(F.sort_array(F.collect_list("e")).alias("e"))
    joined = types.join(nodes, "s", "full_outer")
    parts = F.concat(F.array(F.concat(F.lit('"@id":"'), F.col("s"), F.lit('"'))), F.when(F.col("type").isNotNull(), F.array(F.concat(F.lit('"@type":"'), F.col("type"), F.lit('"')))).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform("e", text), F.array().cast("array<string>")))
    return joined.select("s", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("value"))


def in_order(triples: DataFrame, rows: int = RANGE) -> DataFrame:
    """triples sorted by subject, type first, predicate and object, in ranges (_range), with their number (_n) and the (s, p)
    before and behind each (_before, _behind). A range's ends come from the ranges beside it, one row each, so a subject with
    any share of all triples is spread over ranges and no list of a subject is made."""
    first = F.when(F.col("p") == "rdf:type", 0).otherwise(1)
    placed = in_ranges(triples.withColumn("_key", F.struct("s", first.alias("first"), "p", "o")), "_key", rows)
    order = Window.partitionBy("_range").orderBy("_key")
    pair = lambda key: F.struct(F.col(key)["s"].alias("s"), F.col(key)["p"].alias("p"))
    ends = placed.groupBy("_range").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.count(F.lit(1)).alias("_count"))
    across = Window.orderBy("_range")  # a row a range
    ends = ends.select("_range", F.lag(pair("_high")).over(across).alias("_left"), F.lead(pair("_low")).over(across).alias("_right"), F.coalesce(F.sum("_count").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = placed.withColumns({"_prev": F.lag(pair("_key")).over(order), "_next": F.lead(pair("_key")).over(order), "_in": F.row_number().over(order)})
    met = inner.join(ends, "_range")
    return met.select(*triples.columns, "_range", (F.col("_base") + F.col("_in")).alias("_n"), F.coalesce("_prev", "_left").alias("_before"), F.coalesce("_next", "_right").alias("_behind"))


def _breaks(side: str, *fields: str) -> Column:
    """Whether the neighbour on a side has another subject (and predicate)."""
    same = F.lit(True)
    for name in fields:
        same = same & F.coalesce(F.col(side)[name].eqNullSafe(F.col(name)), F.lit(False))
    return F.col(side).isNull() | ~same


def turtle_lines(triples: DataFrame, rows: int = RANGE) -> DataFrame:
    """_range, _n, value: the lines of turtle()'s blocks, a triple each, from a sort in place of a list per subject."""
    found = in_order(triples, rows)
    name = F.when(F.col("p") == "rdf:type", "a").otherwise(property_name(F.col("p")))
    opening = F.when(_breaks("_before", "s"), F.concat(resource(F.col("s")), F.lit(" "))).otherwise("  ")
    return found.select("_range", "_n", F.concat(opening, name, F.lit(" "), object_term(F.col("p"), F.col("o")), F.when(_breaks("_behind", "s"), " .").otherwise(" ;")).alias("value"))


def _json(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def jsonld_lines(triples: DataFrame, rows: int = RANGE) -> DataFrame:
    """_range, _n, value: jsonld()'s nodes, cut into a line per object; joined without breaks the lines of a subject are its node."""
    types = triples.where("p = 'rdf:type'").groupBy("s").agg(F.max("o").alias("o"))  # of several the last counts
    rest = triples.where("p != 'rdf:type'").select("s", "p", "o")
    found = in_order(types.select("s", F.lit("rdf:type").alias("p"), "o").unionByName(rest), rows)
    opens, closes = _breaks("_before", "s", "p"), _breaks("_behind", "s", "p")
    name = F.when(F.col("p") == "rdf:type", '"@type"').otherwise(_json(F.col("p")))
    value = F.concat(
        F.when(_breaks("_before", "s"), F.concat(F.lit('{"@id":'), _json(F.col("s")))).otherwise(""),
        F.lit(","), F.when(opens, F.concat(name, F.lit(":"))).otherwise(""), F.when(opens & ~closes, "[").otherwise(""),
        _json(F.col("o")), F.when(closes & ~opens, "]").otherwise(""), F.when(_breaks("_behind", "s"), "}").otherwise(""),
    )
    return found.select("_range", "_n", value.alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes lines (_range, _n, value) as text, a folder a range; in the order of the ranges the files are the document."""
    lines.repartition("_range").sortWithinPartitions("_range", "_n").select("_range", "value").write.partitionBy("_range").text(path)


def trig(vocabulary: DataFrame, model: DataFrame, instances: DataFrame) -> dict[str, DataFrame]:
    """The lines (value) of three named graphs, by the graph's name."""
    return {"vocabulary": ntriples(vocabulary), "model": ntriples(model), "instances": ntriples(instances, True)}


def write_trig(graphs: dict[str, DataFrame], path: str) -> None:
    """Writes each graph's lines as text to a folder graph=name. The graphs are written one after another, for a write that
    is partitioned by graph would sort all lines of a task."""
    for name, lines in graphs.items():
        lines.write.text(f"{path}/graph={name}")
