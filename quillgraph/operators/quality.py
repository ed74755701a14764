"""Checks of instances and models: typed attributes, constraints, required links, tags and fields, patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.json_text import field, is_blank, is_string, loose_string, number_of, string_of
from quillgraph.functions.vocab import DATATYPES, DEFAULT_RULES, VALUE_TYPES, default_rules
from quillgraph.operators.joins import link_counts
from quillgraph.sources.files import durable

NUMBERS = ("integer", "decimal", "percentage", "money", "quantity")


def typed(instances: DataFrame, declared: dict[str, str]) -> DataFrame:
    """One plain column per declared attribute, updated_at from created_at where it is missing. Values of another type
    become NULL, not an error."""

    def column(name: str, datatype: str) -> Column:
        text = F.element_at("attributes", F.lit(name))["value"]
        kind = DATATYPES[datatype]
        if kind == "array<string>":
            return F.from_json(text, kind).alias(name)
        if kind.startswith("struct"):
            attribute = F.element_at("attributes", F.lit(name))
            return F.struct(number_of(text).alias("value"), attribute["currencyCode" if datatype == "money" else "unit"].alias("currencyCode" if datatype == "money" else "unit")).alias(name)
        return loose_string(text).try_cast(kind).alias(name) if kind != "string" else string_of(text).alias(name)

    updated = F.coalesce("updated_at", "created_at") if "updated_at" in instances.columns else F.col("created_at")
    return instances.select("id", *[column(n, t) for n, t in declared.items()], updated.alias("updated_at"))


def constraint_fault(text: Column, value_type: str | None = None, regex: str | None = None, enum: list[str] | None = None, low: float | None = None, high: float | None = None, shortest: int | None = None, longest: int | None = None) -> Column:
    """The first broken constraint of a JSON value, or NULL; null and missing pass, a regex and a length test strings only,
    a range tests what reads as a number."""
    if value_type is not None:
        regex, low, high, shortest, longest = (a if a is not None else b for a, b in zip((regex, low, high, shortest, longest), VALUE_TYPES[value_type], strict=True))
    string, number = string_of(text), F.coalesce(number_of(text), string_of(text).try_cast("double"))
    tests = []
    if regex is not None:
        tests.append(F.when(is_string(text) & ~string.rlike(regex), "regex"))
    if enum is not None:
        tests.append(F.when(~loose_string(text).isin(enum), "enum"))
    if low is not None:
        tests.append(F.when(number < low, "range"))
    if high is not None:
        tests.append(F.when(number > high, "range"))
    if shortest is not None:
        tests.append(F.when(F.length(string) < shortest, "length"))
    if longest is not None:
        tests.append(F.when(F.length(string) > longest, "length"))
    return F.when(text.isNotNull() & (text != "null"), F.coalesce(*tests) if tests else F.lit(None).cast("string"))


#: A table of rules: one row per attribute that a Thing declares.
RULES = "thing_id string, attribute string, type string, required boolean, regex string, enum array<string>, low double, high double, shortest int, longest int"


def rules_table(spark: SparkSession, declared: dict[str, dict]) -> DataFrame:
    """declared (thing -> attribute -> {"type", "required", value_type, regex, enum, low, high, shortest, longest}) as a table of
    rules; what a value type says counts where the attribute says nothing."""
    limits = ("regex", "low", "high", "shortest", "longest")
    rows = []
    for thing, attributes in declared.items():
        for name, spec in attributes.items():
            given = dict(zip(limits, VALUE_TYPES.get(spec.get("value_type"), (None,) * 5), strict=True)) | {k: spec[k] for k in limits if spec.get(k) is not None}
            real = lambda k: None if given[k] is None else float(given[k])  # noqa: B023, E731
            rows.append((thing, name, spec["type"], bool(spec.get("required", False)), given["regex"], spec.get("enum"), real("low"), real("high"), given["shortest"], given["longest"]))
    return spark.createDataFrame(rows, RULES)


def _rule_fault(rule: Column) -> Column:
    """The first fault of the attribute that a rule is about: required, type, then constraints; regex and length test strings
    only, a range what reads as a number."""
    attribute = F.element_at("attributes", rule["attribute"])
    text = attribute["value"]
    string, number = string_of(text), F.coalesce(number_of(text), string_of(text).try_cast("double"))
    given = text.isNotNull() & (text != "null")
    return F.coalesce(
        F.when(rule["required"] & (~F.coalesce(given, F.lit(False)) | (text == '""')), "required"),
        F.when(attribute["type"] != rule["type"], "type"),
        F.when(given & is_string(text) & ~F.rlike(string, rule["regex"]), "regex"),
        F.when(given & ~F.array_contains(rule["enum"], loose_string(text)), "enum"),
        F.when(given & ((number < rule["low"]) | (number > rule["high"])), "range"),
        F.when(given & ((F.length(string) < rule["shortest"]) | (F.length(string) > rule["longest"])), "length"),
    )


def validate_instances(instances: DataFrame, declared: DataFrame | dict[str, dict]) -> DataFrame:
    """id, attribute, fault (unknown attributes as warnings) of instances of declared Things (a table of rules, or what
    rules_table takes). A Thing's rules meet its instances as one list (as long as its declaration) and generic tests run on
    their columns, so the plan is the same for any number of Things. Few rules are broadcast by Spark's own size check."""
    rules = declared if isinstance(declared, DataFrame) else rules_table(instances.sparkSession, declared)
    of_thing = rules.groupBy("thing_id").agg(F.collect_list(F.struct(*[c for c in rules.columns if c != "thing_id"])).alias("_rules"))
    found = F.transform("_rules", lambda r: F.struct(r["attribute"].alias("attribute"), _rule_fault(r).alias("fault")))
    unknown = F.transform(F.array_except(F.map_keys("attributes"), F.transform("_rules", lambda r: r["attribute"])), lambda n: F.struct(n.alias("attribute"), F.lit("unknown").alias("fault")))
    lost = F.array(F.struct(F.lit(None).cast("string").alias("attribute"), F.lit("thing").alias("fault")))
    faults = F.when(F.col("_rules").isNull(), lost).otherwise(F.concat(F.filter(found, lambda x: x["fault"].isNotNull()), unknown))
    return instances.join(of_thing, "thing_id", "left").select("id", F.explode(faults).alias("f")).select("id", "f.*")


def validity(faults: DataFrame, instances: DataFrame) -> DataFrame:
    """id, valid, n_faults, n_warnings of every instance."""
    counts = faults.groupBy("id").agg(F.count_if(F.col("fault") != "unknown").alias("n_faults"), F.count_if(F.col("fault") == "unknown").alias("n_warnings"))
    joined = instances.select("id").join(counts, "id", "left").na.fill(0, ["n_faults", "n_warnings"])
    return joined.withColumn("valid", F.col("n_faults") == 0)


def validate_forms(submissions: DataFrame, interfaces: DataFrame | dict[str, str], declared: DataFrame | dict[str, dict]) -> DataFrame:
    """id, attribute, fault of submissions (id, interface_id, attributes): the interface must exist (interfaces: interface_id,
    thing_id), its Thing too, then the Thing's rules hold (types are the Thing's)."""
    known = interfaces if isinstance(interfaces, DataFrame) else submissions.sparkSession.createDataFrame(list(interfaces.items()), "interface_id string, thing_id string")
    placed = submissions.join(known.select("interface_id", "thing_id", F.lit(True).alias("_known")), "interface_id", "left")
    lost = placed.where("_known is null").select("id", F.lit(None).cast("string").alias("attribute"), F.lit("interface").alias("fault"))
    return lost.unionByName(validate_instances(placed.where("_known"), declared))


# Rules over a model. Every rule gives (map_id, entity, rule, message, severity).
def gap(rows: DataFrame, entity: str, rule: str, message: Column | str, severity: str = "warning") -> DataFrame:
    return rows.select("map_id", F.col(entity).alias("entity"), F.lit(rule).alias("rule"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), F.lit(severity).alias("severity"))


def requires_link(model, predicate: str) -> DataFrame:
    """Containers none of whose facets a link of the predicate touches."""
    ends = model.links.where(F.col("predicate") == predicate).select("map_id", F.explode(F.array("source_uri", "target_uri")).alias("uri")).distinct()
    served = model.entities.join(ends, ["map_id", "uri"], "left_semi").select("map_id", F.col("container_uri").alias("uri")).distinct()
    lacking = model.contexts.where("parent_uri is not null").join(served, ["map_id", "uri"], "left_anti")
    return gap(lacking, "uri", "requires-link", f"no {predicate}")


def requires_tag(model, tag: str) -> DataFrame:
    lacking = model.contexts.where(F.col("parent_uri").isNotNull() & ~F.coalesce(F.array_contains("tags", tag), F.lit(False)))
    return gap(lacking, "uri", "requires-tag", f"no tag {tag}")


def requires_entity_links(entities: DataFrame, counts: DataFrame, rules: DataFrame, least: int = 1) -> DataFrame:
    """Entities with fewer links than `least` for a rule (predicate, direction, classes); rules are a small dimension, the
    counts are joined once for all of them."""
    by_class = F.broadcast(rules.select("predicate", "direction", F.explode("classes").alias("class_id")))
    wanted = entities.select("map_id", F.col("uri").alias("id"), "class_id").join(by_class, "class_id")
    # Counts have a row per key, so they are hashed, and the entities, which are many more, need no sort.
    joined = wanted.join(counts.hint("shuffle_hash"), ["map_id", "id", "predicate", "direction"], "left").where(F.coalesce("n", F.lit(0)) < least)
    return gap(joined, "id", "entity-links", F.concat_ws(" ", F.lit("no"), "direction", "predicate"))


def requires_field(entities: DataFrame, name: str, class_id: str, severity: str = "info") -> DataFrame:
    lacking = entities.where((F.col("class_id") == class_id) & is_blank(field(name)))
    return gap(lacking, "uri", "requires-field", f"no {name}", severity)


#: The predicates and directions that default rules ask for. They ask for one link, so links need no counting.
ASKED = {(predicate, direction) for predicate, direction, _ in DEFAULT_RULES}


def default_gaps(model, counts: DataFrame | None = None) -> DataFrame:
    counts = model.linked(ASKED) if counts is None else counts
    return requires_entity_links(model.entities, counts, default_rules(model.spark)).unionByName(requires_field(model.entities, "definition", "Thing"))


def selected(rows: DataFrame, selector: str = "all", value: str | list[str] | None = None) -> DataFrame:
    """The entities that a rule is about: all, those with one of some tags (tagged; no tag selects all), or those of a class
    (entityType)."""
    if selector == "tagged":
        tags = [value] if isinstance(value, str) else list(value or [])
        return rows.where(F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])), F.lit(False))) if tags else rows
    return rows.where(F.col("class_id") == value) if selector == "entityType" else rows


def rule_gaps(model, rules: list[dict], counts: DataFrame | None = None) -> DataFrame:
    """The gaps of user rules that are enabled: dicts of kind (requires-field or requires-link), field or predicate, selector,
    value, severity, enabled. Rules are few and part of the plan; links are counted once for all of them."""
    counts = link_counts(model.links) if counts is None and any(r["kind"] == "requires-link" for r in rules) else counts
    found = []
    for rule in rules:
        if not rule.get("enabled", True):
            continue
        rows, severity = selected(model.entities, rule.get("selector", "all"), rule.get("value")), rule.get("severity", "warning")
        if rule["kind"] == "requires-field":
            found.append(gap(rows.where(is_blank(field(rule["field"]))), "uri", "requires-field", f"no {rule['field']}", severity))
        else:
            linked = counts.where(F.col("predicate") == rule["predicate"]).select("map_id", F.col("id").alias("uri"))
            found.append(gap(rows.join(linked, ["map_id", "uri"], "left_anti"), "uri", "requires-link", f"no {rule['predicate']}", severity))
    none = gap(model.entities.where("false"), "uri", "", "")
    return reduce(lambda a, b: a.unionByName(b), found, none)


def all_gaps(user: DataFrame, defaults: DataFrame) -> DataFrame:
    """User rules' gaps, then default ones unless the same entity and message is reported already."""
    said = user.select("map_id", "entity", "message").distinct()
    return user.unionByName(defaults.join(said, ["map_id", "entity", "message"], "left_anti"))


def gaps_for_changes(model, added: DataFrame) -> DataFrame:
    """The default link rules for entities (map_id, uri) that were just added."""
    fresh = model.entities.join(added.select("map_id", "uri").distinct(), ["map_id", "uri"], "left_semi")
    return requires_entity_links(fresh, model.linked(ASKED), default_rules(model.spark))


def rollup(gaps: DataFrame, entities: DataFrame) -> DataFrame:
    """Per container: gaps by severity, entities, and how complete it is."""
    places = entities.select("map_id", F.col("uri").alias("entity"), "container_uri")
    counted = gaps.join(places, ["map_id", "entity"]).groupBy("map_id", "container_uri").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count(F.lit(1)).alias("total"))
    level = F.when((F.col("errors") > 0) | (F.col("warnings") > 3), "sketched").when((F.col("warnings") > 0) | (F.col("total") > 5), "structured").otherwise("rich")
    everything = entities.groupBy("map_id", "container_uri").agg(F.count(F.lit(1)).alias("entities"))
    return everything.join(counted, ["map_id", "container_uri"], "left").na.fill(0, ["errors", "warnings", "total"]).withColumn("level", level)


def top_gaps(gaps: DataFrame, n: int = 5) -> DataFrame:
    """The first n gaps by severity, rule, entity and message, with the number of the rest."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    gaps = durable(gaps, "gaps")
    first = gaps.withColumn("_rank", rank).orderBy("_rank", "rule", "entity", "message").limit(n).drop("_rank")
    return first.withColumn("more", F.lit(max(gaps.count() - n, 0)).cast("long"))


#: Entities of a task.
SHARE = 250_000


def orphan_entities(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities that no link touches; links as such or as ends (map_id, id; an end may occur more than once)."""
    both = F.explode(F.array("source_uri", "target_uri")).alias("uri")
    ends = links.select("map_id", F.col("id").alias("uri")) if "id" in links.columns else links.select("map_id", both).distinct()
    # As many parts as the entities need, so that a task's share doesn't grow with them.
    parts = max(1, -(-entities.count() // SHARE))
    return entities.repartition(parts, "map_id", "uri").join(ends.repartition(parts, "map_id", "uri").hint("shuffle_hash"), ["map_id", "uri"], "left_anti")


def port_patterns(ports: DataFrame, links: DataFrame) -> DataFrame:
    """Ports without a value stream, and ports that neither produce nor consume."""
    ends = links.select("map_id", "predicate", F.explode(F.array("source_uri", "target_uri")).alias("uri"))
    without = lambda found, name: ports.join(found.select("map_id", "uri").distinct(), ["map_id", "uri"], "left_anti").select("map_id", "uri", F.lit(name).alias("pattern"))
    return without(ends.where("predicate = 'valueStream'"), "no-value-stream").unionByName(without(ends.where("predicate in ('produces', 'consumes')"), "no-payload"))


#: Predicates that may cross containers without a port.
CROSSING = ("valueStream", "childOf", "memberOf", "extends", "sameConceptAs")


def bypassed_ports(links: DataFrame, owners: DataFrame, ports: DataFrame) -> DataFrame:
    """Links between containers of which the source's has ports (owners: map_id, id, container_uri)."""
    source = owners.select("map_id", F.col("id").alias("source_uri"), F.col("container_uri").alias("_from"))
    target = owners.select("map_id", F.col("id").alias("target_uri"), F.col("container_uri").alias("_to"))
    crossing = links.where(~F.col("predicate").isin(*CROSSING)).join(source, ["map_id", "source_uri"]).join(target, ["map_id", "target_uri"]).where("_from != _to")
    having = ports.select("map_id", F.col("container_uri").alias("_from")).distinct()
    return crossing.join(having, ["map_id", "_from"], "left_semi").drop("_from", "_to")


def infer_roles(things: DataFrame, links: DataFrame) -> DataFrame:
    """A Thing that another owns is a part, any other a root."""
    owned = links.where("predicate = 'owns'").select("map_id", F.col("target_uri").alias("uri")).distinct().withColumn("_owned", F.lit(True))
    return things.join(owned, ["map_id", "uri"], "left").select("map_id", "uri", F.when(F.col("_owned"), "part").otherwise("root").alias("role"))


def bundle_check(instances: DataFrame, models: DataFrame) -> DataFrame:
    """Instances without a Thing as errors, models without a creation time as warnings."""
    errors = instances.where("thing_id is null").select(F.col("id").alias("what"), F.lit("error").alias("severity"))
    return errors.unionByName(models.where("created_at is null").select(F.col("map_id").alias("what"), F.lit("warning").alias("severity")))
