"""Actions in bulk: a table of requests is checked against gates, then turned into commands and events.

actions: action, performers_only, mode. params: action, name, type, required. requests: request, action, user, params
map<string,string> (JSON text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.json_text import is_string, loose_string, number_of, string_of
from quillgraph.operators.queues import fifo
from quillgraph.operators.scan import RANGE
from quillgraph.sources.files import durable


def gate(requests: DataFrame, actions: DataFrame, params: DataFrame, performers: DataFrame, facts: DataFrame | None = None, needs: DataFrame | None = None, instances: DataFrame | None = None, conditions: DataFrame | None = None) -> DataFrame:
    """request, action, user, params, fault: the first that applies of no-action, missing-param, param-type, not-allowed,
    precondition. Definitions are dimensions (broadcast below Spark's size limit); preconditions of states (needs: action,
    thing, state) hold if some instance of the thing (facts: thing, state) satisfies them, those of fields (conditions: action,
    thing, attribute, operator of exists, equals, gt, lt, value) if some instance (instances: thing_id, attributes) does."""
    declared = params.groupBy("action").agg(F.collect_list(F.struct("name", "type", "required")).alias("declared"))
    joined = requests.join(actions.withColumn("_known", F.lit(True)), "action", "left").join(declared, "action", "left")
    allowed = performers.select("action", "user").distinct().withColumn("_performs", F.lit(True))
    joined = joined.join(allowed, ["action", "user"], "left")
    value = lambda d: F.element_at("params", d["name"])
    given = F.coalesce("declared", F.array().cast("array<struct<name: string, type: string, required: boolean>>"))
    missing = F.exists(given, lambda d: d["required"] & value(d).isNull())
    wrong = F.exists(given, lambda d: F.coalesce(F.when(d["type"] == "number", number_of(value(d)).isNull()).when(d["type"] == "boolean", ~value(d).isin("true", "false")).otherwise(~is_string(value(d))) & value(d).isNotNull(), F.lit(False)))
    refused = F.col("performers_only") & F.col("_performs").isNull()
    fault = F.when(F.col("_known").isNull(), "no-action").when(missing, "missing-param").when(wrong, "param-type").when(refused, "not-allowed")
    if facts is not None and needs is not None:
        met = needs.join(facts.select("thing", "state").distinct().withColumn("_met", F.lit(True)), ["thing", "state"], "left").groupBy("action").agg(F.min(F.coalesce("_met", F.lit(False))).alias("_ready"))
        joined = joined.join(met, "action", "left")
        fault = F.coalesce(fault, F.when(~F.coalesce("_ready", F.lit(True)), "precondition"))
    if instances is not None and conditions is not None:
        joined = joined.join(fields_ready(instances, conditions), "action", "left")
        fault = F.coalesce(fault, F.when(~F.coalesce("_fit", F.lit(True)), "precondition"))
    return joined.select("request", "action", "user", "params", fault.alias("fault"))


def fields_ready(instances: DataFrame, conditions: DataFrame) -> DataFrame:
    """action, _fit: whether each of an action's field conditions holds for some instance. Values are compared as texts or as
    numbers, a missing one as none, null as 0; instances are reduced to a flag per condition before anything moves."""
    asked = conditions.select("action", "thing", "attribute", "operator", F.col("value").alias("_expected"))
    text = F.element_at("attributes", F.col("attribute"))["value"]
    number = F.when(text == "null", F.lit(0.0)).when(text.isin("true", "false"), (text == "true").cast("double")).otherwise(F.coalesce(number_of(text), string_of(text).try_cast("double")))
    given, expected = F.coalesce(loose_string(text), F.when(text == "null", F.lit("null")), F.lit("undefined")), F.col("_expected").try_cast("double")
    fits = F.when(F.col("operator") == "exists", text.isNotNull() & (text != "null")).when(F.col("operator") == "equals", given == F.col("_expected")).when(F.col("operator") == "gt", number > expected).when(F.col("operator") == "lt", number < expected)
    keys = ["action", "thing", "attribute", "operator", "_expected"]
    held = instances.select(F.col("thing_id").alias("thing"), "attributes").join(asked, "thing").groupBy(*keys).agg(F.max(F.coalesce(fits, F.lit(False))).alias("_holds"))
    held = held.select(*[F.col(k).alias(f"_k{k}") for k in keys], "_holds")
    same = [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys]
    return asked.join(held, same, "left").groupBy("action").agg(F.min(F.coalesce("_holds", F.lit(False))).alias("_fit"))


def attributes_given(rules: DataFrame) -> DataFrame:
    """rules whose source `attribute` (arg: the attribute, arg_thing: of what) is replaced by the source of that field in the
    last step before that creates the thing, or by none. Each round resolves one reference; they point backwards."""
    made = rules.where("effect = 'create'")
    fields = made.select(*[F.col(c).alias(f"_{c}") for c in ("action", "thing", "step", "field", "source", "arg", "arg_thing")])
    steps = made.select(F.col("action").alias("_action"), F.col("thing").alias("_thing"), F.col("step").alias("_step")).distinct()
    # Where several steps create the thing, the last one before counts.
    places = rules.where("source = 'attribute'").select("action", "step", "arg_thing").distinct()
    before = places.join(steps, (F.col("action") == F.col("_action")) & (F.col("arg_thing") == F.col("_thing")) & (F.col("_step") < F.col("step"))).groupBy("action", "step", "arg_thing").agg(F.max("_step").alias("_made"))
    while not rules.where("source = 'attribute'").isEmpty():
        open_ = rules.where("source = 'attribute'").join(before.select("action", F.col("step").alias("_origin"), "arg_thing", "_made"), ["action", "_origin", "arg_thing"], "left")
        same = (F.col("action") == F.col("_action")) & (F.col("_made") == F.col("_step")) & (F.col("arg_thing") == F.col("_thing")) & (F.col("arg") == F.col("_field"))
        found = open_.join(fields, same, "left")
        others = [c for c in rules.columns if c not in ("source", "arg", "arg_thing", "_origin")]
        moved = found.select(*others, F.coalesce("_source", F.lit("none")).alias("source"), F.col("_arg").alias("arg"), F.col("_arg_thing").alias("arg_thing"), F.coalesce("_step", "_origin").alias("_origin"))
        more = moved.where("source = 'attribute'").select("action", F.col("_origin").alias("step"), "arg_thing").distinct()
        more = more.join(steps, (F.col("action") == F.col("_action")) & (F.col("arg_thing") == F.col("_thing")) & (F.col("_step") < F.col("step"))).groupBy("action", "step", "arg_thing").agg(F.max("_step").alias("_made"))
        before = before.unionByName(more).distinct()
        rules = durable(rules.where("source is null or source != 'attribute'").unionByName(moved.select(*rules.columns)), "rules")
    return rules.drop("_origin", "arg_thing")


def effects(accepted: DataFrame, rules: DataFrame, instances: DataFrame, relationships: DataFrame | None = None, rows: int = RANGE) -> DataFrame:
    """request, step, effect, target, field, value of accepted requests (in the order of `request`, step by step): each sees what
    those before have done.

    rules: action, step, effect (create, modify, transitionState, delete, createLink, deleteLink, emit), thing, field, source
    (param, static, user, time: the request's ts, attribute: of a row that an earlier step creates), arg; for attributes
    arg_thing, for links predicate, source_ref, target_ref. What an earlier step of the request creates of a thing stands for
    that thing: a modify or a new state goes to it, a link's ends that name the thing are it. Otherwise these go to the thing's
    first instance, and a delete takes it: at first the smallest id (instances: thing, id), new ones come behind in the order
    they are made; where there is none the effect is no-instance. A removed link is its source's first one (relationships: id,
    predicate, source_id; then those made), no row if it has none. Links of deleted instances are left to delete_instances.
    Without relationships, links are created only. An event's target is its own id. Rules are dimensions.
    """
    for name in ("predicate", "source_ref", "target_ref", "arg_thing"):
        if name not in rules.columns:
            rules = rules.withColumn(name, F.lit(None).cast("string"))
    rules = attributes_given(rules.withColumn("_origin", F.col("step")))
    created = rules.where("effect = 'create'").select(F.col("action").alias("_action"), F.col("step").alias("_step"), F.col("thing").alias("_thing")).distinct()

    def made_before(rules: DataFrame, ref: str, out: str) -> DataFrame:
        """The last step before that creates what `ref` names."""
        same = (F.col("action") == F.col("_action")) & (F.col(ref) == F.col("_thing")) & (F.col("_step") < F.col("step"))
        found = rules.join(created, same, "left").drop("_action", "_thing")
        return found.groupBy(*rules.columns).agg(F.max("_step").alias(out))

    for ref, out in (("thing", "_made"), ("source_ref", "_from"), ("target_ref", "_to")):
        rules = made_before(rules, ref, out)
    kind = F.col("effect")
    when = F.col("ts").cast("string") if "ts" in accepted.columns else F.lit(None).cast("string")
    value = F.when(F.col("source") == "param", F.element_at("params", F.col("arg"))).when(F.col("source") == "user", F.col("user")).when(F.col("source") == "time", when).when(F.col("source") == "none", F.lit(None)).otherwise(F.col("arg"))
    own = lambda kind, step: F.concat_ws("/", F.lit(kind), F.col("request").cast("string"), F.col(step).cast("string"))
    end = lambda ref, step: F.when(F.col(step).isNotNull(), own("new", step)).otherwise(F.col(ref))
    steps = accepted.select("request", "action", "user", "params", when.alias("ts")).join(rules, "action").withColumns({"_value": value, "_source": end("source_ref", "_from"), "_target": end("target_ref", "_to")})
    steps = durable(steps.select("request", "step", "effect", "thing", "field", "predicate", "_made", "_value", "_source", "_target"), "steps")

    turn = F.struct("request", "step").alias("turn")
    asks = F.when(kind == "create", "push").when(kind == "delete", "pop").when(kind.isin("modify", "transitionState") & F.col("_made").isNull(), "peek")
    turns = steps.select("thing", turn, asks.alias("kind"), F.when(kind == "create", own("new", "step")).alias("id")).where("kind is not null").distinct()
    met = fifo(turns, instances.select("thing", "id"), ["thing"], "turn", rows).where("kind != 'push'").select(F.col("turn.request").alias("request"), F.col("turn.step").alias("step"), "taken")
    there = F.when(F.col("_made").isNotNull() & (kind != "delete"), own("new", "_made")).otherwise(F.col("taken"))
    target = F.when(kind == "create", own("new", "step")).when(kind == "emit", own("event", "step")).when(kind == "createLink", F.col("_source")).otherwise(there)
    name = F.when(kind == "createLink", F.col("predicate")).when(kind == "transitionState", F.lit("_state")).otherwise(F.col("field"))
    # Only what takes or looks at an instance meets the queues; the other steps know their target.
    taking = asks.isin("pop", "peek")
    plain = steps.where(F.coalesce(taking, F.lit(False))).join(met, ["request", "step"], "left")
    plain = plain.unionByName(steps.where((kind != "deleteLink") & ~F.coalesce(taking, F.lit(False))).withColumn("taken", F.lit(None).cast("string")))
    plain = plain.select("request", "step", F.when(target.isNull(), "no-instance").otherwise(kind).alias("effect"), target.alias("target"), name.alias("field"), F.when(kind == "createLink", F.col("_target")).otherwise(F.col("_value")).alias("value"))
    if relationships is None:
        return plain
    links = steps.where(kind.isin("createLink", "deleteLink")).select(F.col("_source").alias("source_id"), "predicate", turn, F.when(kind == "createLink", "push").otherwise("pop").alias("kind"), F.when(kind == "createLink", own("link", "step")).alias("id"))
    gone = fifo(links, relationships.select("source_id", "predicate", "id"), ["source_id", "predicate"], "turn", rows).where("kind = 'pop' and taken is not null")
    return plain.unionByName(gone.select("turn.request", "turn.step", F.lit("deleteLink").alias("effect"), F.col("source_id").alias("target"), F.col("predicate").alias("field"), F.col("taken").alias("value")))
