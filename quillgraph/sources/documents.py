"""Whole model documents, walked as variants: facets of kinds that no schema names, every property of containers and links.

A document's objects become maps of variants whose keys are exploded, so a kind or field that nobody foresaw is a row or a key
like any other. Fields keep their JSON text with sorted keys, so equal values have equal texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.vocab import FACETS
from quillgraph.sources.files import durable

#: Parts of a container that become rows of their own.
PARTS = ("facets", "customFacets", "symbols", "contexts", "links", "customTypes")


def at(value: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({value}, '$.{path}', '{kind}')")


def fields_of(value: str) -> Column:
    """The JSON text of every top-level field of an object."""
    return F.transform_values(F.expr(f"try_variant_get({value}, '$', 'map<string, variant>')"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def flatten(documents: DataFrame) -> dict[str, DataFrame]:
    """containers, entities, links and kinds of documents (map_id, body); bodies that don't parse give nothing.

    containers: map_id, uri, parent_uri (NULL: the root), name, tags, fields (all that isn't a row elsewhere). entities: map_id,
    uri, class_id, facet_key, is_custom, container_uri, name, tags, fields, ord; facets, custom facets (class_id is the kind
    that the document declares for their key, else the key) and symbols. links: map_id, uri, predicate, source_uri,
    target_uri, label, description, pattern, metadata, fields, ord. kinds: map_id, id, plural_key of declared kinds.
    """
    parsed = documents.select("map_id", F.try_parse_json("body").alias("d")).where("d is not null")
    inner = parsed.select("map_id", F.explode(at("d", "contexts", "map<string, variant>")).alias("_key", "c"), F.lit(False).alias("root"))
    all_ = parsed.select("map_id", F.col("d").alias("c"), F.lit(True).alias("root")).unionByName(inner.drop("_key"))
    uri, text = at("c", "uri", "string"), lambda v, n: at(v, n, "string").alias(n)
    tags = lambda v: F.coalesce(at(v, "tags", "array<string>"), F.array().cast("array<string>")).alias("tags")
    parent = F.when(~F.col("root"), at("c", "parentUri", "string")).alias("parent_uri")
    containers = all_.select("map_id", uri.alias("uri"), parent, text("c", "name"), tags("c"), F.map_filter(fields_of("c"), lambda k, _: ~k.isin(*PARTS)).alias("fields"))

    kinds = parsed.select("map_id", F.explode(at("d", "customTypes", "array<variant>")).alias("k")).select("map_id", text("k", "id"), at("k", "pluralKey", "string").alias("plural_key"))
    shape = lambda key, custom, rows: F.struct(key.alias("facet_key"), F.lit(custom).alias("is_custom"), rows.alias("rows"))
    keyed = lambda part, custom: F.transform(F.map_entries(F.coalesce(at("c", part, "map<string, array<variant>>"), F.create_map().cast("map<string, array<variant>>"))), lambda e: shape(e["key"], custom, e["value"]))
    symbols = F.array(shape(F.lit("symbols"), False, at("c", "symbols", "array<variant>")))
    groups = all_.select("map_id", uri.alias("container_uri"), F.explode(F.concat(keyed("facets", False), keyed("customFacets", True), symbols)).alias("g"))
    rows = groups.select("map_id", "container_uri", "g.facet_key", "g.is_custom", F.posexplode("g.rows").alias("ord", "e"))
    known = {**FACETS, "symbols": "Symbol"}
    class_id = F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("facet_key"))
    named = rows.join(kinds.select("map_id", F.col("plural_key").alias("facet_key"), F.col("id").alias("_kind"), F.lit(True).alias("is_custom")), ["map_id", "facet_key", "is_custom"], "left")
    named = named.where(F.col("is_custom") | class_id.isNotNull())
    class_id = F.when(F.col("is_custom"), F.coalesce("_kind", "facet_key")).otherwise(class_id)
    entities = named.select("map_id", at("e", "uri", "string").alias("uri"), class_id.alias("class_id"), "facet_key", "is_custom", "container_uri", text("e", "name"), tags("e"), fields_of("e").alias("fields"), F.col("ord").cast("long").alias("ord"))

    found = parsed.select("map_id", F.posexplode(at("d", "links", "array<variant>")).alias("ord", "l"))
    metadata = F.to_json(at("l", "metadata", "variant")).alias("metadata")
    links = found.select("map_id", text("l", "uri"), text("l", "predicate"), at("l", "sourceUri", "string").alias("source_uri"), at("l", "targetUri", "string").alias("target_uri"), text("l", "label"), text("l", "description"), text("l", "pattern"), metadata, fields_of("l").alias("fields"), F.col("ord").cast("long").alias("ord"))
    return {"containers": containers, "entities": entities, "links": links, "kinds": kinds}


def snapshot(flat: dict[str, DataFrame]) -> DataFrame:
    """The rows that versions.diff and versions.merge take: roots, contexts, facets of all kinds, symbols and links."""
    c, e, links = flat["containers"], flat["entities"], flat["links"]
    kind = F.when(F.col("parent_uri").isNull(), "root").otherwise("context")
    parts = [
        c.select(kind.alias("kind"), "uri", F.col("parent_uri").alias("container_uri"), F.lit("Context").alias("class_id"), "name", "fields"),
        e.select(F.when(F.col("class_id") == "Symbol", "symbol").otherwise("facet").alias("kind"), "uri", "container_uri", "class_id", "name", "fields"),
        links.select(F.lit("link").alias("kind"), "uri", F.lit(None).cast("string").alias("container_uri"), F.col("predicate").alias("class_id"), F.lit(None).cast("string").alias("name"), "fields"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Where facets hold ids of others, or of parts of their own.
ID_PATHS = {
    "things": ("attributes.referencedThingId", "states.id", "states.transitions.id", "states.transitions.targetStateId", "states.transitions.triggerActionId", "states.transitions.triggerEventId"),
    "workflows": ("triggerStepId", "trigger.refId", "steps.id", "steps.transitions.id", "steps.transitions.targetStepId"),
}


def fresh(salt: str, id_: Column) -> Column:
    """A new id: a hash of salt and id, so that all references agree without a table of ids."""
    return F.concat(F.lit("bm:"), F.sha2(F.concat_ws("|", F.lit(salt), id_), 256))


def _rewritten(salt: str):
    """Field texts of facets with the ids in them renewed and attachments without blobs; the ids that were renewed."""

    def new(id_: str) -> str:
        return "bm:" + hashlib.sha256(f"{salt}|{id_}".encode()).hexdigest()

    def renew(node, steps: list[str], seen: list[str]) -> None:
        if isinstance(node, list):
            for x in node:
                renew(x, steps, seen)
        elif isinstance(node, dict) and steps[0] in node:
            if len(steps) > 1:
                renew(node[steps[0]], steps[1:], seen)
            elif isinstance(node[steps[0]], str) and node[steps[0]]:
                seen.append(node[steps[0]])
                node[steps[0]] = new(node[steps[0]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids = [], []
            for key, fields in zip(batch.column("facet_key").to_pylist(), batch.column("fields").to_pylist(), strict=True):
                known, seen = dict(fields or ()), []
                for path in ID_PATHS.get(key, ()):
                    first, *rest = path.split(".")
                    if first in known:
                        node = {first: json.loads(known[first])}
                        renew(node, [first, *rest], seen)
                        known[first] = json.dumps(node[first], ensure_ascii=False, separators=(",", ":"), sort_keys=True)
                if key == "interfaces" and "attachments" in known:
                    held = json.loads(known["attachments"])
                    held = [a for a in held if not (isinstance(a, dict) and a.get("kind") == "blob")] if isinstance(held, list) else held
                    if held:
                        known["attachments"] = json.dumps(held, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
                    else:
                        del known["attachments"]
                out.append(list(known.items()))
                ids.append(seen)
            columns = [batch.column(c) for c in batch.schema.names]
            columns[batch.schema.names.index("fields")] = pa.array(out, pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.string()))], names=[*batch.schema.names, "_ids"])

    return rows


def re_id(flat: dict[str, DataFrame], salt: str) -> dict[str, DataFrame]:
    """Copies of whole documents under fresh ids. Containers, facets, symbols, links and their ends, states, steps and what refers
    to them get new ids; representedBy of custom facets does where what it names is part of the copy, else it stays;
    attachments that are blobs go. Everything else stays as it is."""
    entities = flat["entities"]
    standard = F.when(~F.col("is_custom"), F.col("facet_key"))
    shape = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in entities.schema.fields)}, _own string, _ids array<string>"
    made = durable(entities.withColumn("_own", F.col("facet_key")).withColumn("facet_key", standard).mapInArrow(_rewritten(salt), shape), "renewed")
    made = made.withColumn("facet_key", F.col("_own")).drop("_own")

    links = flat["links"]
    ids = [flat["containers"].select("map_id", F.col("uri").alias("id")), entities.select("map_id", F.col("uri").alias("id")), made.select("map_id", F.explode("_ids").alias("id")), links.select("map_id", F.explode(F.array("uri", "source_uri", "target_uri")).alias("id"))]
    known = reduce(lambda a, b: a.unionByName(b), ids).where("id is not null").distinct()
    shown = F.when(F.col("is_custom"), F.get_json_object(F.element_at("fields", F.lit("representedBy")), "$"))
    met = made.drop("_ids").withColumn("_shown", shown).join(known.select("map_id", F.col("id").alias("_shown"), F.lit(True).alias("_known")), ["map_id", "_shown"], "left")
    text = lambda id_: F.to_json(F.array(id_)).substr(F.lit(2), F.length(F.to_json(F.array(id_))) - 2)
    changed = F.map_filter(F.create_map(F.lit("uri"), F.when(F.col("uri").isNotNull(), text(fresh(salt, F.col("uri")))), F.lit("representedBy"), F.when(F.col("_known"), text(fresh(salt, F.col("_shown"))))), lambda _, v: v.isNotNull())
    met = met.withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, _: ~F.array_contains(F.map_keys(changed), k)), changed))
    renewed = lambda c: F.when(F.col(c).isNotNull(), fresh(salt, F.col(c))).alias(c)
    entities = met.select(*[renewed(c) if c in ("uri", "container_uri") else F.col(c) for c in flat["entities"].columns])
    containers = flat["containers"].select(*[renewed(c) if c in ("uri", "parent_uri") else F.col(c) for c in flat["containers"].columns])
    return flat | {"entities": entities, "containers": containers, "links": links.select(*[renewed(c) if c in ("uri", "source_uri", "target_uri") else F.col(c) for c in links.columns])}


def _with(text: Column, name: str, value: Column) -> Column:
    """JSON text of an object with one more string, keys sorted."""
    rest = F.when(F.coalesce(text, F.lit("null")).isin("null", "{}"), F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(text, 2, 1 << 30)))
    return F.to_json(F.parse_json(F.concat(F.lit(f'{{"{name}":"'), value, F.lit('"'), rest)))


def _sets(fields: Column, **new: Column) -> Column:
    """Fields with new texts; a NULL leaves a field out."""
    made = F.create_map(*[x for n, v in new.items() for x in (F.lit(n), v)])
    return F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(*new)), F.map_filter(made, lambda _, v: v.isNotNull()))


def lift_attachments(flat: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Old documents' single attachment of a note and media of an interface as lists of attachments with ids (hashes of the owner's
    uri), and annotation links that name no attachment with that of their source: one join by source. Conditions of actions that
    are plain texts become objects. What has the new form already is left alone, so a second run changes nothing."""
    entities, f = flat["entities"], lambda n: F.element_at("fields", F.lit(n))
    old = F.when(F.col("is_custom"), F.lit(None)).when(F.col("facet_key") == "symbols", f("attachment")).when(F.col("facet_key") == "interfaces", f("media"))
    there = F.coalesce(f("attachments").startswith("["), F.lit(False))
    lift = ~there & old.isNotNull() & ~old.isin("null", "false", "0", '""')
    own = F.concat(F.lit("bm:attachment:"), F.sha2("uri", 256))
    listed = F.concat(F.lit("["), _with(old, "attachmentId", own), F.lit("]"))
    single = F.when(F.col("facet_key") == "symbols", "attachment").otherwise("media")
    fields = F.when(lift, F.map_concat(F.map_filter("fields", lambda k, _: (k != single) & (k != "attachments")), F.create_map(F.lit("attachments"), listed))).otherwise(F.col("fields"))
    lifted = entities.withColumn("fields", fields)
    for name in ("preconditions", "postconditions"):
        each = F.transform(F.expr(f"try_variant_get(try_parse_json(fields['{name}']), '$', 'array<variant>')"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.concat(F.lit('{"description":'), F.to_json(v), F.lit(',"type":"text"}'))).otherwise(F.to_json(v)))
        changed = F.when((F.col("facet_key") == "actions") & each.isNotNull(), F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))).otherwise(f(name))
        lifted = lifted.withColumn("fields", _sets(F.col("fields"), **{name: changed}))
    # Written once: marks and links meet plain columns, no filter is pushed into (and copies) the expressions above.
    lifted = durable(lifted.select(*entities.columns), "lifted")
    first = F.get_json_object(f("attachments"), "$[0].attachmentId")
    marks = lifted.where("not is_custom and facet_key in ('symbols', 'interfaces')").select("map_id", F.col("uri").alias("source_uri"), first.alias("_mark")).where("_mark != ''").dropDuplicates(["map_id", "source_uri"])
    links = flat["links"].join(marks, ["map_id", "source_uri"], "left")
    stamp = (F.col("predicate") == "annotates") & F.col("_mark").isNotNull() & (F.coalesce(F.get_json_object("metadata", "$.attachmentId"), F.lit("")) == "")
    metadata = F.when(stamp, _with(F.col("metadata"), "attachmentId", F.col("_mark"))).otherwise(F.col("metadata"))
    links = links.withColumn("metadata", metadata).withColumn("fields", F.when(stamp, _sets(F.col("fields"), metadata=F.col("metadata"))).otherwise(F.col("fields")))
    return flat | {"entities": lifted, "links": links.select(*flat["links"].columns)}
