"""The runtime log of all command kinds: rejections, domain events and compensating commands, by segmented scans.

A log row has sequence, ts, cmd_type, type_uri, class_id (of the type; instances only), uri and changes, a map of JSON text: the
whole record for a command that opens one, the fields it sets for others. A record's state before a command follows from its
last opening or deletion, what later commands set in each top-level field, and how many attempts failed since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.json_text import quoted
from quillgraph.functions.vocab import IMMUTABLE, INSTANTIABLE, RUNTIME_COMMANDS, RUNTIME_FIELDS
from quillgraph.operators.scan import RANGE, before, in_ranges

KEY = ["_family", "_type", "uri"]


def _of(part: str) -> Column:
    """A column of the table of commands for a row's command."""
    known = {command: spec[part] for command, spec in RUNTIME_COMMANDS.items() if spec.get(part)}
    return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("cmd_type"))


def _unfit() -> Column:
    """Why a command is rejected whatever the state, or NULL."""
    opens, instance = F.col("_turn") == "open", F.col("_family") == "instance"
    return (
        F.when(F.col("_turn").isNull(), "unknown-command")
        .when(opens & instance & F.col("class_id").isNull(), "unknown-type")
        .when(opens & instance & ~F.col("class_id").isin(*INSTANTIABLE), "not-instantiable")
        .when(opens & F.col("uri").isNull(), "no-uri")
        .when(instance & F.col("_turn").isin("set", "delete") & F.col("class_id").isin(*IMMUTABLE), "immutable")
    )


def judged(log: DataFrame, rows: int = RANGE) -> DataFrame:
    """log with _family, _turn, _type, reason (NULL where a command is accepted) and what it meets: turn, the last opening or
    deletion of its record before (sequence, opens, record)."""
    family = F.substring_index("cmd_type", ":", 1)
    shaped = log.withColumns({"_family": family, "_turn": _of("turn"), "_type": F.when(family == "instance", F.col("type_uri"))})
    shaped = in_ranges(shaped.withColumn("_unfit", _unfit()), "sequence", rows)
    turns = F.when(F.col("_unfit").isNull() & F.col("_turn").isin("open", "delete"), F.struct("sequence", (F.col("_turn") == "open").alias("opens"), F.when(F.col("_turn") == "open", F.col("changes")).alias("record")))
    met = before(shaped, KEY, "sequence", {"turn": turns})
    absent = F.when(F.col("_turn").isin("set", "status", "delete") & ~F.coalesce("turn.opens", F.lit(False)), "absent")
    return met.withColumn("reason", F.coalesce("_unfit", absent)).drop("_unfit")


def rejections(log: DataFrame, rows: int = RANGE) -> DataFrame:
    return judged(log, rows).where("reason is not null").select("sequence", "cmd_type", "uri", "reason")


def events(log: DataFrame, rows: int = RANGE) -> DataFrame:
    """sequence, uri, event, ts: one event per accepted command; progress of runs and snapshots of simulations give none."""
    return judged(log, rows).where("reason is null").select("sequence", "uri", _of("event").alias("event"), "ts").where("event is not null")


def inverses(log: DataFrame, rows: int = RANGE) -> DataFrame:
    """sequence, uri, inverse, changes: the command that undoes each accepted one. What opened a record is undone by the
    command that closes it (an upsert over an existing instance by the former one), what set fields by their former values
    (NULL: there was none), what closed or deleted a record by opening the former one, a link by its removal."""
    accepted = judged(log, rows).where("reason is null")
    # What a command sets: its own fields, the status it stands for, the time it stamps.
    stamps = F.map_filter(F.create_map(F.lit("status"), quoted(_of("status")), F.coalesce(_of("stamp"), F.lit("-")), F.when(_of("stamp").isNotNull(), quoted(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))), lambda _, v: v.isNotNull())
    own = F.map_filter("changes", lambda k, _: ~F.array_contains(F.map_keys(stamps), k))
    sets = F.col("_turn").isin("set", "status")
    accepted = accepted.withColumns({"_sets": F.when(sets, F.map_concat(own, stamps)), "_since": F.col("turn.sequence")})
    fails = F.when(F.col("cmd_type") == "writebackQueue:fail", 1)
    last = {f"f_{f}": F.element_at("_sets", F.lit(f)) for f in RUNTIME_FIELDS}
    met = before(accepted, [*KEY, "_since"], "sequence", last, {"_fails": fails})

    record = F.coalesce("turn.record", F.create_map().cast("map<string,string>"))
    newest = [x for f in RUNTIME_FIELDS for x in (F.lit(f), F.coalesce(f"f_{f}", F.element_at(record, F.lit(f))))]
    count = F.when(F.element_at(record, F.lit("attemptCount")).isNotNull(), (F.element_at(record, F.lit("attemptCount")).cast("long") + F.col("_fails")).cast("string"))
    kept = F.map_filter(record, lambda k, _: ~k.isin(*RUNTIME_FIELDS, "attemptCount"))
    former = F.map_concat(kept, F.map_filter(F.create_map(*newest, F.lit("attemptCount"), count), lambda _, v: v.isNotNull()))
    was = lambda name: F.element_at("_former", F.lit(name))
    command, turn = F.col("cmd_type"), F.col("_turn")
    reopened = (command == "instance:upsert") & F.coalesce("turn.opens", F.lit(False))
    nothing = F.create_map().cast("map<string,string>")
    back = (
        F.when(command == "pipelineRun:complete", F.create_map(F.lit("status"), F.when(was("status").isin('"completed"', '"failed"'), was("status")).otherwise('"completed"')))
        .when(command == "pipelineRun:progress", F.create_map(F.lit("recordsProcessed"), F.coalesce(was("recordsProcessed"), F.lit("0")), F.lit("recordsFailed"), F.coalesce(was("recordsFailed"), F.lit("0"))))
        .when(command == "simRun:snapshot", F.create_map(F.lit("snapshotUri"), F.coalesce(was("snapshotUri"), F.lit('""'))))
        .when(turn == "set", F.map_from_entries(F.transform(F.map_keys("changes"), lambda k: F.struct(k.alias("key"), F.element_at("_former", k).alias("value")))))
        .when(turn.isin("status", "delete") | reopened, F.col("_former"))
        .when(turn == "free", F.col("changes"))
        .otherwise(nothing)
    )
    inverse = F.when(reopened, "instance:upsert").otherwise(_of("inverse"))
    return met.withColumn("_former", former).select("sequence", "uri", inverse.alias("inverse"), back.alias("changes"))
