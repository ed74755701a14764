"""Versions of models: field and row diffs, three-way merges, conflicts, reverse changes, bulk edits, migrations.

A snapshot is (kind, uri, container_uri, class_id, name, fields map<string,string>), one row per root property set,
context, facet, link or symbol. Everything is a join on (kind, uri); snapshots that are compared twice keep their
partitioning, and rows are compared by a hash of their canonical text before any field list is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.joins import prune_retyped
from quillgraph.sources.files import durable

KEY = ["kind", "uri"]
PLACED = ("container_uri", "class_id", "name")


def changed_fields(a: Column, b: Column) -> Column:
    """Sorted names of the keys whose JSON text differs, keys on one side included."""
    both = F.map_zip_with(a, b, lambda _, x, y: ~x.eqNullSafe(y))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda _, v: v)))


def whole(snapshot: DataFrame) -> DataFrame:
    """KEY, and everything else as one map, so that moves (containerId), retypes (facetType) and names are fields too."""
    extra = F.map_filter(F.create_map(F.lit("containerId"), F.col("container_uri"), F.lit("facetType"), F.col("class_id"), F.lit("name"), F.col("name")), lambda _, v: v.isNotNull())
    own = F.map_filter("fields", lambda k, _: ~k.isin("containerId", "facetType", "name"))
    return snapshot.select(*KEY, F.map_concat(own, extra).alias("row"))


def _hash(row: str) -> Column:
    return F.xxhash64(F.to_json(F.array_sort(F.map_entries(row))))


def diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """kind, uri, change_type (added, removed, modified), changed_fields, base_row, target_row; equal rows don't appear."""
    a = whole(base).withColumnRenamed("row", "base_row")
    b = whole(target).withColumnRenamed("row", "target_row")
    both = a.join(b, KEY, "full_outer")
    kind = F.when(F.col("base_row").isNull(), "added").when(F.col("target_row").isNull(), "removed").when(_hash("base_row") != _hash("target_row"), "modified")
    return both.withColumn("change_type", kind).where("change_type is not null").withColumn("changed_fields", F.when(F.col("change_type") == "modified", changed_fields(F.col("base_row"), F.col("target_row"))))


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row per key of any side: outcome (keep, ours, theirs, merged, removed, conflict), conflict_fields, row (NULL
    where it is gone; of a conflict, ours until it is resolved), base_row, ours_row, theirs_row."""
    a, b, c = (whole(x).withColumnRenamed("row", f"{n}_row") for x, n in ((base, "base"), (ours, "ours"), (theirs, "theirs")))
    rows = a.join(b, KEY, "full_outer").join(c, KEY, "full_outer")
    col = F.col
    same = lambda x, y: col(x).isNull() & col(y).isNull() | col(x).isNotNull() & col(y).isNotNull() & (_hash(x) == _hash(y))
    we, they = changed_fields(col("base_row"), col("ours_row")), changed_fields(col("base_row"), col("theirs_row"))
    common = F.filter(F.array_intersect(we, they), lambda f: ~F.element_at("ours_row", f).eqNullSafe(F.element_at("theirs_row", f)))
    three = col("base_row").isNotNull() & col("ours_row").isNotNull() & col("theirs_row").isNotNull()
    outcome = (
        F.when(same("ours_row", "theirs_row"), F.when(col("ours_row").isNull(), "removed").when(same("base_row", "ours_row"), "keep").otherwise("ours"))
        .when(same("base_row", "theirs_row"), F.when(col("ours_row").isNull(), "removed").otherwise("ours"))
        .when(same("base_row", "ours_row"), F.when(col("theirs_row").isNull(), "removed").otherwise("theirs"))
        .when(three & (F.size(common) == 0), "merged")
        .otherwise("conflict")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("conflict_fields", F.when(three & (outcome == "conflict"), common))
    fields = F.map_filter(F.map_zip_with("ours_row", "theirs_row", lambda k, x, y: F.when(F.array_contains(they, k), y).otherwise(x)), lambda _, v: v.isNotNull())
    row = F.when(col("outcome") == "merged", fields).when(col("outcome").isin("theirs"), col("theirs_row")).when(col("outcome") != "removed", col("ours_row"))
    return rows.withColumn("row", row)


def conflicts(merged: DataFrame) -> DataFrame:
    change = lambda side: F.when(F.col(f"{side}_row").isNull(), "removed").when(F.col("base_row").isNull(), "added").otherwise("modified")
    return merged.where("outcome = 'conflict'").select(*KEY, change("ours").alias("ours_change"), change("theirs").alias("theirs_change"), "conflict_fields", "ours_row", "theirs_row")


def resolve(merged: DataFrame, resolutions: DataFrame) -> DataFrame:
    """merged with conflicts decided by resolutions (kind, uri, side: ours or theirs); the others stay conflicts."""
    joined = merged.join(resolutions, KEY, "left")
    decided = (F.col("outcome") == "conflict") & F.col("side").isNotNull()
    row = F.when(decided, F.when(F.col("side") == "ours", F.col("ours_row")).otherwise(F.col("theirs_row"))).otherwise(F.col("row"))
    outcome = F.when(decided, F.when(row.isNull(), "removed").otherwise(F.col("side"))).otherwise(F.col("outcome"))
    return joined.withColumn("_outcome", outcome).withColumn("row", row).withColumn("outcome", F.col("_outcome")).drop("side", "_outcome")


def merged_links(merged: DataFrame) -> DataFrame:
    """kind, uri of the merge's links both of whose ends are left: a link that one side kept goes with what the other removed."""
    left = merged.where("row is not null")
    ends = left.where("kind != 'link'").select("uri").distinct()
    links = left.where("kind = 'link'").select("kind", "uri", F.element_at("row", "source").alias("source"), F.element_at("row", "target").alias("target"))
    kept = links.join(ends.withColumnRenamed("uri", "source"), "source", "left_semi")
    return kept.join(ends.withColumnRenamed("uri", "target"), "target", "left_semi").select("kind", "uri")


def reverse(changes: DataFrame) -> DataFrame:
    """The change set that undoes another."""
    back = F.when(F.col("change_type") == "added", "removed").when(F.col("change_type") == "removed", "added").otherwise("modified")
    return changes.select(*KEY, back.alias("change_type"), "changed_fields", F.col("target_row").alias("base_row"), F.col("base_row").alias("target_row"))


def apply_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows (kind, uri, row) after a change set."""
    joined = rows.join(changes.select(*KEY, "change_type", "target_row"), KEY, "full_outer")
    kept = joined.where("change_type is null or change_type != 'removed'")
    return kept.select(*KEY, F.when(F.col("change_type").isNull(), F.col("row")).otherwise(F.col("target_row")).alias("row"))


# Bulk edits over entities, links and contexts.
def cascade_remove(tree: DataFrame, contexts: DataFrame, entities: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """contexts, entities and links that are left when the contexts `gone` (uri) go with all below them, and the links that
    went. tree: node, ancestor, depth, each node its own ancestor at depth 0."""
    places = tree.join(gone.withColumnRenamed("uri", "ancestor"), "ancestor", "left_semi").select(F.col("node").alias("uri")).distinct()
    contents = entities.join(places.withColumnRenamed("uri", "container_uri"), "container_uri", "left_semi").select("uri")
    dead = durable(places.union(contents).distinct(), "removed")
    kept = links.join(dead.withColumnRenamed("uri", "source_uri"), "source_uri", "left_anti").join(dead.withColumnRenamed("uri", "target_uri"), "target_uri", "left_anti")
    pruned = links.join(dead.withColumnRenamed("uri", "source_uri"), "source_uri", "left_semi").unionByName(links.join(dead.withColumnRenamed("uri", "source_uri"), "source_uri", "left_anti").join(dead.withColumnRenamed("uri", "target_uri"), "target_uri", "left_semi"))
    return contexts.join(places, "uri", "left_anti"), entities.join(dead, "uri", "left_anti"), kept, pruned


def remove_entities(entities: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities without single facets and symbols (gone: map_id, uri), the links that are left, and the links that went with
    them: those that touch something that was there and goes, once each."""
    dead = durable(entities.join(gone.select("map_id", "uri").distinct(), ["map_id", "uri"], "left_semi").select("map_id", "uri"), "removed")
    mark = lambda end: dead.select("map_id", F.col("uri").alias(end), F.lit(True).alias(f"_{end}"))
    met = links.join(mark("source_uri"), ["map_id", "source_uri"], "left").join(mark("target_uri"), ["map_id", "target_uri"], "left")
    touched = F.coalesce("_source_uri", "_target_uri", F.lit(False))
    return entities.join(dead, ["map_id", "uri"], "left_anti"), met.where(~touched).select(*links.columns), met.where(touched).select(*links.columns)


def classify_as_contexts(symbols: DataFrame, links: DataFrame, choices: DataFrame, name: Column, description: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Contexts made of symbols (choices: map_id, uri, parent_uri) under new ids, the symbols and links that are left, and the
    links that went: a context takes none of its symbol's links along."""
    fresh = F.concat(F.lit("bm:ctx:"), F.sha2("uri", 256))
    made = symbols.join(choices.select("map_id", "uri", "parent_uri"), ["map_id", "uri"]).select("map_id", fresh.alias("uri"), "parent_uri", name.alias("name"), description.alias("description"), F.col("uri").alias("from_uri"))
    return made, *remove_entities(symbols, links, choices)


def retype(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities with the class of changes (map_id, id, new_class): id and name stay, a description becomes a definition for
    Things and the other way round for the rest."""
    joined = entities.join(changes.select("map_id", F.col("id").alias("uri"), "new_class"), ["map_id", "uri"], "left")
    text = F.coalesce(F.element_at("fields", "definition"), F.element_at("fields", "description"))
    rest = F.map_filter("fields", lambda k, _: ~k.isin("definition", "description"))
    name = F.when(F.col("new_class") == "Thing", "definition").otherwise("description")
    fields = F.when(F.col("new_class").isNull(), F.col("fields")).when(text.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(name, text)))
    return joined.withColumn("fields", fields).withColumn("class_id", F.coalesce("new_class", "class_id")).drop("new_class")


def retype_model(entities: DataFrame, links: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities under their new classes, and the links without those that their predicates don't allow any more."""
    return retype(entities, changes), prune_retyped(links, changes, entities.sparkSession)


def classify_model(symbols: DataFrame, links: DataFrame, choices: DataFrame, name: Column) -> tuple[DataFrame, DataFrame]:
    """classify(), and the links without those that the new facets' classes don't allow."""
    facets, led = classify(symbols, links, choices, name)
    changed = choices.select(F.col("map_id"), F.concat(F.lit("bm:facet:"), F.sha2("uri", 256)).alias("id"), "new_class")
    return facets, prune_retyped(led, changed, symbols.sparkSession)


def classify(symbols: DataFrame, links: DataFrame, choices: DataFrame, name: Column) -> tuple[DataFrame, DataFrame]:
    """Facets made of symbols (choices: uri, new_class) under new ids, and the links led to them."""
    ids = choices.select("uri", "new_class", F.concat(F.lit("bm:facet:"), F.sha2("uri", 256)).alias("new_uri"))
    facets = symbols.join(ids, "uri").select(F.col("new_uri").alias("uri"), F.col("new_class").alias("class_id"), "container_uri", name.alias("name"), F.col("uri").alias("from_uri"))
    source = ids.select(F.col("uri").alias("source_uri"), F.col("new_uri").alias("_s"))
    target = ids.select(F.col("uri").alias("target_uri"), F.col("new_uri").alias("_t"))
    led = links.join(source, "source_uri", "left").join(target, "target_uri", "left").withColumns({"source_uri": F.coalesce("_s", "source_uri"), "target_uri": F.coalesce("_t", "target_uri")})
    return facets, led.drop("_s", "_t")


def move(entities: DataFrame, moves: DataFrame) -> DataFrame:
    """Entities in the containers of moves (map_id, uri, to)."""
    return entities.join(moves, ["map_id", "uri"], "left").withColumn("container_uri", F.coalesce("to", "container_uri")).drop("to")


def re_id(salt: str, contexts: DataFrame, entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies under fresh ids: a new id is a hash of salt and id, so references agree without a table of ids; references to
    what isn't part of the copy stay as they are."""
    known = contexts.select("uri").union(entities.select("uri")).distinct()
    fresh = lambda c: F.concat(F.lit("bm:"), F.sha2(F.concat_ws("|", F.lit(salt), c), 256))

    def led(rows: DataFrame, column: str) -> DataFrame:
        marked = rows.join(known.select(F.col("uri").alias(column), F.lit(True).alias("_known")), column, "left")
        return marked.withColumn(column, F.when(F.col("_known"), fresh(F.col(column))).otherwise(F.col(column))).drop("_known")

    new_contexts = led(contexts.withColumn("uri", fresh(F.col("uri"))), "parent_uri")
    new_entities = led(entities.withColumn("uri", fresh(F.col("uri"))), "container_uri")
    return new_contexts, new_entities, led(led(links, "source_uri"), "target_uri")


def migrate(documents: DataFrame) -> DataFrame:
    """Old documents (map_id, version, entities array<struct<uri, type, mode, content, contentDoc, attachment, attachments>>)
    to version 4; what has a later version already is left alone, so a second run changes nothing.

    1: attribute type number becomes decimal, any other unknown one text. 2: symbol modes doc and code become card.
    3: contentDoc from content. 4: a single attachment becomes the list of attachments.
    """
    from quillgraph.functions.vocab import DATATYPES

    version = F.col("version")
    known = list(DATATYPES)

    def up(e: Column) -> Column:
        kind = F.when((version < 1) & (e["type"] == "number"), "decimal").when((version < 1) & e["type"].isNotNull() & ~e["type"].isin(known), "text").otherwise(e["type"])
        mode = F.when((version < 2) & e["mode"].isin("doc", "code"), "card").otherwise(e["mode"])
        doc = F.when((version < 3) & e["contentDoc"].isNull() & e["content"].isNotNull(), F.to_json(F.struct(F.lit("doc").alias("type"), e["content"].alias("text")))).otherwise(e["contentDoc"])
        files = F.when((version < 4) & e["attachment"].isNotNull() & (F.coalesce(F.size(e["attachments"]), F.lit(0)) < 1), F.array(e["attachment"])).otherwise(e["attachments"])
        one = F.when(version < 4, F.lit(None).cast("string")).otherwise(e["attachment"])
        return F.struct(e["uri"].alias("uri"), kind.alias("type"), mode.alias("mode"), e["content"].alias("content"), doc.alias("contentDoc"), one.alias("attachment"), files.alias("attachments"))

    return documents.withColumn("entities", F.transform("entities", up)).withColumn("version", F.greatest(version, F.lit(4)))
