"""Joins over a model: names, neighbours, link checks, lineage, resolution of mapped links.

All joins are on keys; dimension tables of fixed size are broadcast, everything else is left to Spark's own choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.json_text import field, string_of
from quillgraph.functions.vocab import PREDICATE_LABELS, predicates


def named(model) -> DataFrame:
    """map_id, id, name, class_id, container_uri of everything that links can touch."""
    content = F.substring(string_of(field("content")), 1, 80)
    entities = model.entities.unionByName(model.symbols).select("map_id", F.col("uri").alias("id"), F.coalesce("name", string_of(field("label")), content, "uri").alias("name"), "class_id", "container_uri")
    places = model.contexts.select("map_id", F.col("uri").alias("id"), F.coalesce("name", "uri").alias("name"), F.lit("Context").alias("class_id"), F.col("parent_uri").alias("container_uri"))
    return entities.unionByName(places)


def resolve_names(ids: DataFrame, model) -> DataFrame:
    """Every id with its name and class; an unknown id is its own name."""
    return ids.join(named(model).select("map_id", "id", "name", "class_id"), ["map_id", "id"], "left").withColumn("name", F.coalesce("name", "id"))


def link_targets(ids: DataFrame, links: DataFrame, predicate: str | None = None) -> DataFrame:
    own = links if predicate is None else links.where(F.col("predicate") == predicate)
    return own.join(ids.select("map_id", F.col("id").alias("source_uri")), ["map_id", "source_uri"], "left_semi").select("map_id", F.col("source_uri").alias("id"), "predicate", F.col("target_uri").alias("neighbour"))


def link_sources(ids: DataFrame, links: DataFrame, predicate: str | None = None) -> DataFrame:
    own = links if predicate is None else links.where(F.col("predicate") == predicate)
    return own.join(ids.select("map_id", F.col("id").alias("target_uri")), ["map_id", "target_uri"], "left_semi").select("map_id", F.col("target_uri").alias("id"), "predicate", F.col("source_uri").alias("neighbour"))


def link_counts(links: DataFrame) -> DataFrame:
    """map_id, id, predicate, direction, n: links at each end; one partial aggregation, shared by filters and rules."""
    ends = links.select("map_id", "predicate", F.explode(F.array(F.struct(F.col("source_uri").alias("id"), F.lit("outgoing").alias("direction")), F.struct(F.col("target_uri").alias("id"), F.lit("incoming").alias("direction")))).alias("e"))
    return ends.groupBy("map_id", F.col("e.id").alias("id"), "predicate", F.col("e.direction").alias("direction")).agg(F.count(F.lit(1)).alias("n"))


def link_summary(model) -> DataFrame:
    """map_id, id, predicate, direction, n: an entity's number of links per predicate and direction, for predicates whose
    domain (outgoing) or range (incoming) holds its class; steps are left out. Names at the other end: link_lines, a row each."""
    rules = F.broadcast(predicates(model.spark).where(~F.col("predicate").startswith("step:")).select("predicate", "domain", "range"))
    fits = F.array_contains(F.when(F.col("direction") == "outgoing", F.col("domain")).otherwise(F.col("range")), F.col("class_id"))
    return model.counted_links().join(rules, "predicate").where(fits).select("map_id", "id", "predicate", "direction", "n")


def link_lines(model) -> DataFrame:
    """map_id, id, label, neighbour, name: a row for every link of an entity, from both ends, under what business calls its
    predicate there; only where the class is in the predicate's domain (or range). Rows, not lists: a hub has many."""
    labels = F.create_map(*[x for p, (out, into) in PREDICATE_LABELS.items() for x in (F.lit(p), F.array(F.lit(out), F.lit(into)))])
    rules = predicates(model.spark).where(~F.col("structural") & F.col("predicate").isin(*PREDICATE_LABELS)).withColumn("_label", F.element_at(labels, F.col("predicate")))
    names = named(model).select("map_id", "id", "name", "class_id")
    links = model.links.join(F.broadcast(rules), "predicate")  # as many rows as there are predicates
    side = lambda own, other, ends, k: links.select("map_id", F.col(own).alias("id"), F.col(other).alias("neighbour"), F.col(ends).alias("_fit"), F.get("_label", F.lit(k)).alias("label"))
    ends = side("source_uri", "target_uri", "domain", 0).unionByName(side("target_uri", "source_uri", "range", 1))
    own = ends.join(names.select("map_id", "id", "class_id"), ["map_id", "id"]).where(F.array_contains("_fit", F.col("class_id")))
    there = names.select("map_id", F.col("id").alias("neighbour"), F.col("name").alias("_name"))
    return own.join(there, ["map_id", "neighbour"], "left").select("map_id", "id", "label", "neighbour", F.coalesce("_name", "neighbour").alias("name"))


def has_link(rows: DataFrame, links: DataFrame, predicate: str, direction: str = "outgoing", least: int = 1, most: int | None = None) -> DataFrame:
    """Entities with at least `least` and at most `most` links; least = 0 lets those without links through."""
    end = "source_uri" if direction == "outgoing" else "target_uri"
    counts = links.where(F.col("predicate") == predicate).groupBy("map_id", F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    found = rows.join(counts, ["map_id", "id"], "left" if least == 0 else "inner").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.where((F.col("n") >= least) & (F.lit(True) if most is None else F.col("n") <= most))


def relationships_of(relationships: DataFrame, ids: DataFrame, direction: str = "both", predicate: str | None = None) -> DataFrame:
    """Relationships that touch the ids: one join per direction (no OR in a join), a relationship once."""
    own = relationships if predicate is None else relationships.where(F.col("predicate") == predicate)
    out = own.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    into = own.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    if direction != "both":
        return out if direction == "out" else into
    return out.unionByName(into).dropDuplicates(["id"])


#: What a link between contexts may be.
PATTERNS = ("partnership", "customer-supplier", "conformist", "anticorruption-layer", "open-host-service", "published-language", "shared-kernel", "separate-ways")


def validate_links(links: DataFrame, model) -> DataFrame:
    """Every link with the code of its first fault, or NULL."""
    classes = named(model).select("map_id", "id", "class_id")
    rules = F.broadcast(predicates(model.spark))
    joined = (
        links.join(classes.select("map_id", F.col("id").alias("source_uri"), F.col("class_id").alias("source_class")), ["map_id", "source_uri"], "left")
        .join(classes.select("map_id", F.col("id").alias("target_uri"), F.col("class_id").alias("target_class")), ["map_id", "target_uri"], "left")
        .join(rules, "predicate", "left")
    )
    untyped = (F.col("source_class") == "Symbol") | (F.col("target_class") == "Symbol")
    fault = (
        F.when(F.col("source_uri") == F.col("target_uri"), "self-link")
        .when(F.col("source_class").isNull(), "source-missing")
        .when(F.col("target_class").isNull(), "target-missing")
        .when(untyped, F.lit(None))
        .when(F.col("domain").isNull(), "unknown-predicate")
        .when(~F.array_contains("domain", F.col("source_class")), "domain")
        .when(~F.array_contains("range", F.col("target_class")), "range")
        .when((F.col("predicate") == "extends") & (F.col("source_class") != F.col("target_class")), "extends-class")
    )
    if "pattern" in links.columns:  # an empty one is none
        fault = F.coalesce(fault, F.when(F.col("source_class").isNotNull() & F.col("target_class").isNotNull() & (F.col("pattern") != "") & ~F.col("pattern").isin(*PATTERNS), "pattern"))
    return joined.select("map_id", "uri", "predicate", "source_uri", "target_uri", fault.alias("fault"))


def prune_dangling(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose two ends are among the known ids (map_id, id). Targets first: what a link points to goes more often than
    what it starts from, so fewer links move for their sources."""
    ends = known.select("map_id", "id").distinct()
    kept = links.join(ends.withColumnRenamed("id", "target_uri"), ["map_id", "target_uri"], "left_semi")
    return kept.join(ends.withColumnRenamed("id", "source_uri"), ["map_id", "source_uri"], "left_semi")


def prune_retyped(links: DataFrame, changed: DataFrame, spark) -> DataFrame:
    """Links without those that violate a predicate's domain or range after entities changed class (map_id, id,
    new_class); links of unknown predicates stay."""
    source = changed.select("map_id", F.col("id").alias("source_uri"), F.col("new_class").alias("_source"))
    target = changed.select("map_id", F.col("id").alias("target_uri"), F.col("new_class").alias("_target"))
    joined = links.join(source, ["map_id", "source_uri"], "left").join(target, ["map_id", "target_uri"], "left").join(F.broadcast(predicates(spark)), "predicate", "left")
    fits = lambda ends, end: F.col(ends).isNull() | F.col(end).isNull() | F.array_contains(F.col(ends), F.col(end))
    return joined.where(fits("domain", "_source") & fits("range", "_target")).select(*links.columns)


def orphan_contexts(contexts: DataFrame) -> DataFrame:
    parents = contexts.select("map_id", F.col("uri").alias("parent_uri"))
    return contexts.where("parent_uri is not null").join(parents, ["map_id", "parent_uri"], "left_anti")


def lookup(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples by any pattern of subject, predicate and object."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples


def run_lineage(triples: DataFrame, runs: DataFrame, status: str) -> DataFrame:
    """pipeline, run, instance: what the runs of a status have produced."""
    wanted = runs.where(F.col("status") == status).select(F.col("uri").alias("run"))
    of = triples.where("p = 'runFor'").select(F.col("s").alias("run"), F.col("o").alias("pipeline"))
    made = triples.where("p = 'producedBy'").select(F.col("o").alias("run"), F.col("s").alias("instance"))
    return made.join(wanted, "run", "left_semi").join(of, "run")


def resolve_links(mapped: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapped links (source_id, predicate, target_type, target_external_id) with their target instance, and the pending
    rest. Popular targets make a skewed key on the left only, which adaptive execution splits."""
    targets = instances.select(F.col("type_uri").alias("target_type"), F.col("external_id").alias("target_external_id"), F.col("uri").alias("target_uri"))
    keys = ["target_type", "target_external_id"]
    return mapped.join(targets, keys), mapped.join(targets.select(*keys), keys, "left_anti")


def populating_pipeline(pipelines: DataFrame, populates: DataFrame) -> DataFrame:
    """type_uri, pipeline: the first (by order of links) two-way, writeback-enabled pipeline of each type."""
    able = pipelines.where("two_way and writeback").select("pipeline")
    first = Window.partitionBy("type_uri").orderBy("ord")
    return populates.join(able, "pipeline", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("type_uri", "pipeline")


def containers(model) -> DataFrame:
    return model.contexts.select("map_id", F.col("uri").alias("container_uri"), F.col("name").alias("context_name"))


def facet_count_bounds(model, class_id: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Containers with too few or too many facets of a class."""
    counts = model.entities.where(F.col("class_id") == class_id).groupBy("map_id", "container_uri").agg(F.count(F.lit(1)).alias("n"))
    held = containers(model).join(counts, ["map_id", "container_uri"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = F.lit(False) if least is None else F.col("n") < least
    many = F.lit(False) if most is None else F.col("n") > most
    return held.where(few | many).select("map_id", "container_uri", "n", F.when(few, "too-few").otherwise("too-many").alias("fault"))


def shared_terms(model) -> DataFrame:
    """Names of things, in lower case, that two containers or more use."""
    return model.entities.where("class_id = 'Thing'").groupBy("map_id", F.lower("name").alias("term")).agg(F.count_distinct("container_uri").alias("n_containers"), F.count(F.lit(1)).alias("n")).where("n_containers >= 2")


def shared_term_places(model) -> DataFrame:
    """term, container_uri, n: where the shared terms are used; a row per place, so that a term of everywhere is no list."""
    uses = model.entities.where("class_id = 'Thing'").groupBy("map_id", F.lower("name").alias("term"), "container_uri").agg(F.count(F.lit(1)).alias("n"))
    shared = shared_terms(model).select("map_id", "term")
    return uses.join(shared, ["map_id", "term"], "left_semi")


def god_contexts(model, most: int = 20) -> DataFrame:
    """Contexts, not the root, with more facets than `most`."""
    inner = model.contexts.where("parent_uri is not null").select("map_id", F.col("uri").alias("container_uri"))
    counts = model.entities.groupBy("map_id", "container_uri").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return counts.join(inner, ["map_id", "container_uri"], "left_semi")


def crossing_links(model) -> DataFrame:
    """Links between two containers, with the containers and names of their ends."""
    places = named(model).select("map_id", "id", F.coalesce("container_uri", "id").alias("place"), "name")
    end = lambda side: places.select("map_id", F.col("id").alias(f"{side}_uri"), F.col("place").alias({"source": "from_place", "target": "to_place"}[side]), F.col("name").alias(f"{side}_name"))
    return model.links.join(end("source"), ["map_id", "source_uri"]).join(end("target"), ["map_id", "target_uri"]).where("from_place != to_place")


def boundary_names(model) -> DataFrame:
    """container_uri, way, predicate, name: what a container gives to others (out: the names of its links' targets there) and
    takes from them (in: the names of the sources), each name once."""
    crossing = crossing_links(model)
    given = crossing.select("map_id", F.col("from_place").alias("container_uri"), F.lit("out").alias("way"), "predicate", F.col("target_name").alias("name"))
    taken = crossing.select("map_id", F.col("to_place").alias("container_uri"), F.lit("in").alias("way"), "predicate", F.col("source_name").alias("name"))
    return given.unionByName(taken).distinct()


def boundary_table(model) -> DataFrame:
    """Per container: its facets by class, and links that come in from and go out to other containers, by predicate."""
    crossing = crossing_links(model)
    both = crossing.select("map_id", "predicate", F.explode(F.array(F.struct(F.col("from_place").alias("place"), F.lit("out").alias("way")), F.struct(F.col("to_place").alias("place"), F.lit("in").alias("way")))).alias("e"))
    links = both.groupBy("map_id", F.col("e.place").alias("container_uri"), F.concat_ws(":", "e.way", "predicate").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    facets = model.entities.groupBy("map_id", "container_uri", F.concat(F.lit("facet:"), F.col("class_id")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return links.unionByName(facets)


def glossary(model) -> DataFrame:
    """Things with a definition that isn't blank, by container and name."""
    text = F.trim(string_of(field("definition")))
    things = model.entities.where("class_id = 'Thing'").withColumn("definition", text).where("definition != ''")
    return things.join(containers(model), ["map_id", "container_uri"], "left").select("context_name", "name", F.col("uri").alias("id"), "definition")


def page(instances: DataFrame, thing_id: str, offset: int, limit: int) -> DataFrame:
    """A page of a Thing's instances in the order of creation; Spark keeps the first offset + limit rows per task only."""
    return instances.where(F.col("thing_id") == thing_id).orderBy("created_at", "id").offset(offset).limit(limit)
