"""Records to instances: iterate, filter, identity, fields, links; upserts, refreshes, patches, deletes, writeback.

A mapping is compiled to one projection, so that a record is read once and no step shuffles; only upserts and link
resolution move rows, by (type, external id).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import json_text
from quillgraph.functions.paths import is_path, value_at, variant_at
from quillgraph.functions.transforms import Registry


@dataclass(frozen=True)
class Field:
    source: str
    transform: str | None = None
    default: str | None = None


@dataclass(frozen=True)
class Mapping:
    thing: str
    identity: str
    fields: dict[str, Field]
    iterate: str | None = None
    filter: str | None = None
    links: dict[str, tuple[str, str]] = field(default_factory=dict)  # predicate -> (target type, path)


def iterate(responses: DataFrame, path: str | None, body: str = "body") -> DataFrame:
    """One row per record with its index: the elements of the array at `path`; a value that isn't an array is one record,
    a missing one none."""
    whole = responses.withColumn("_at", variant_at(F.try_parse_json(body), path)).drop(body)
    is_list = F.schema_of_variant("_at").startswith("ARRAY<")
    items = F.when(F.col("_at").isNull(), F.array().cast("array<variant>")).when(is_list, F.expr("try_variant_get(_at, '$', 'array<variant>')")).otherwise(F.array("_at"))
    return whole.select(*[c for c in whole.columns if c != "_at"], F.posexplode(items).alias("record_index", "record"))


def passes(record: Column, path: str | None) -> Column:
    return F.lit(True) if path is None else json_text.truthy(value_at(record, path))


def identity(record: Column, path: str) -> Column:
    """The external id as text; NULL where it is missing or null."""
    value = value_at(record, path)
    return F.when(value.isNotNull() & (value != "null"), json_text.loose_string(value))


def mapped_field(record: Column, spec: Field, registry: Registry) -> tuple[Column, Column]:
    """The value (JSON text) and the error, if any. A default stands in only for what is missing; null is a value."""
    raw = value_at(record, spec.source)
    if spec.transform is not None and spec.transform not in registry:
        return F.lit(None).cast("string"), F.lit(f"unknown transform {spec.transform}")
    made = registry.call(spec.transform, raw) if spec.transform else raw
    value = made if spec.default is None else F.coalesce(made, F.lit(spec.default))
    failed = F.when(raw.isNotNull() & made.isNull(), "transform failed").otherwise("missing") if spec.default is None else F.lit(None).cast("string")
    return value, F.when(value.isNull(), failed)


def run_mapping(records: DataFrame, mapping: Mapping, registry: Registry | None = None) -> DataFrame:
    """The input's columns without the record, then external_id, fields, links, status (ok, skipped, error), error_field
    and reason: the first fault in the order identity, fields."""
    registry = registry or Registry()
    record = F.col("record")
    key = identity(record, mapping.identity)
    pairs = {name: mapped_field(record, spec, registry) for name, spec in mapping.fields.items()}
    faults = F.coalesce(F.when(key.isNull(), F.struct(F.lit("identity").alias("field"), F.lit("missing").alias("reason"))), *[F.when(fault.isNotNull(), F.struct(F.lit(name).alias("field"), fault.alias("reason"))) for name, (_, fault) in pairs.items()])
    links = [F.struct(F.lit(p).alias("predicate"), F.lit(t).alias("target_type"), identity(record, path).alias("target_external_id")) for p, (t, path) in mapping.links.items()]
    kept = passes(record, mapping.filter)
    rows = records.select(
        *[c for c in records.columns if c != "record"],
        F.lit(mapping.thing).alias("type_uri"), key.alias("external_id"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in pairs]), F.array(*[v for v, _ in pairs.values()])).alias("fields"),
        F.filter(F.array(*links), lambda x: x["target_external_id"].isNotNull()).alias("links") if links else F.array().cast("array<struct<predicate: string, target_type: string, target_external_id: string>>").alias("links"),
        kept.alias("_kept"), faults.alias("_fault"),
    )
    status = F.when(~F.col("_kept"), "skipped").when(F.col("_fault").isNotNull(), "error").otherwise("ok")
    return rows.withColumn("status", status).withColumn("error_field", F.when(F.col("_kept"), F.col("_fault.field"))).withColumn("reason", F.when(F.col("_kept"), F.col("_fault.reason"))).drop("_kept", "_fault")


def mapping_errors(mapped: DataFrame) -> DataFrame:
    return mapped.where("status = 'error'")


def mapped_links(mapped: DataFrame) -> DataFrame:
    return mapped.where("status = 'ok'").select("type_uri", "external_id", F.explode("links").alias("l")).select("type_uri", "external_id", "l.*")


def payload(mapping: Mapping) -> Column:
    """The source's form of an instance as JSON text; a field goes to the last step of its path, constants and undefined
    values without a default are left out."""
    values = {spec.source.split(".")[-1]: F.coalesce(F.element_at("fields", F.lit(name)), F.lit(spec.default)) for name, spec in mapping.fields.items() if is_path(spec.source)}
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{n}":'), v)) for n, v in sorted(values.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def reverse(instances: DataFrame, mapping: Mapping) -> DataFrame:
    return instances.select("external_id", payload(mapping).alias("payload"))


def upsert(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """The target with the batch's last row per (type, external id) in place of its own. Rows of one key are reduced by a
    partial maximum before they move, so a key with very many updates costs one row per task."""
    keys = ["type_uri", "external_id"]
    rest = [c for c in target.columns if c not in keys]
    newest = batch.where("external_id is not null").groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    return target.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def full_refresh(mirror: DataFrame, result: DataFrame, read_ok: DataFrame) -> DataFrame:
    """The mirror with the Things that were read (thing_id, ok) replaced by the result; a failed read keeps the old rows."""
    good = read_ok.where("ok").select("thing_id")
    return mirror.join(good, "thing_id", "left_anti").unionByName(result.join(good, "thing_id", "left_semi"))


def computed(instances: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A derived Thing: pure expressions over each instance; rows in which one fails (NULL) are dropped."""
    made = instances.select("id", *[c.alias(n) for n, c in columns.items()])
    return made.where(F.coalesce(F.expr(" and ".join(f"`{n}` is not null" for n in columns)), F.lit(False)))


def patch(instances: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, changed map, updated_at) override single attributes; the others stay."""
    latest = changes.groupBy("id").agg(F.max_by("changed", "updated_at").alias("changed"), F.max("updated_at").alias("_new"))
    both = instances.join(latest, "id", "left")
    kept = F.map_filter("attributes", lambda k, _: ~F.array_contains(F.map_keys("changed"), k))
    attributes = F.when(F.col("changed").isNull(), F.col("attributes")).otherwise(F.map_concat(kept, "changed"))
    return both.select("id", attributes.alias("attributes"), F.coalesce("_new", "updated_at").alias("updated_at"))


def delete(instances: DataFrame, relationships: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the ids that are gone and the relationships that touch them."""
    left = instances.join(gone, "id", "left_anti")
    kept = relationships.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return left, kept


def guard(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes that may go ahead, and violations: from a simulation only to targets that are one or accept it. A write's
    environment is its pipeline's, else its source's, else prod."""
    placed = writes.withColumn("env", F.coalesce("pipeline_env", "source_env", F.lit("prod")))
    wrong = (F.col("env") == "simulation") & (F.coalesce("target_env", F.lit("prod")) != "simulation") & ~F.coalesce("target_accepts", F.lit(False))
    return placed.where(~wrong), placed.where(wrong)


def writeback_queue(changed: DataFrame, pipelines: DataFrame, mapping: Mapping) -> DataFrame:
    """Queue rows of changed instances (type_uri, external_id, sequence, fields) with a pipeline for their type: the
    payload, and an idempotency key that is the same in every rerun."""
    rows = changed.where("external_id is not null").join(pipelines, "type_uri")
    key = F.sha2(F.concat_ws(":", "pipeline", "external_id", F.col("sequence").cast("string")), 256)
    return rows.select("pipeline", "type_uri", "external_id", payload(mapping).alias("payload"), key.alias("idempotency_key"))


def run_report(mapped: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: fetched, mapped, skipped, errors, written and a status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = mapped.groupBy(run).agg(F.count(F.lit(1)).alias("fetched"), n("ok"), n("skipped"), n("error"), F.max("external_id").alias("cursor"))
    status = F.when((F.col("error") > 0) & (F.col("ok") == 0), "failed").when(F.col("error") > 0, "partial").otherwise("ok")
    return counts.select(run, "fetched", F.col("ok").alias("mapped"), "skipped", F.col("error").alias("errors"), F.col("ok").alias("written"), status.alias("status"), "cursor")
