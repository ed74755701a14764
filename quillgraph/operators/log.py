"""Command logs: tails after checkpoints, replay into state, inverses, rejected commands, operational tables.

Replay needs no fold in order. What a key's row is depends on its last upsert or delete and on the later updates, so a
partial maximum per key gives the state; a key with very many commands costs one row per task. What each command meets comes
from a segmented scan (scan.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.vocab import DEVICE_LOCAL, IMMUTABLE, INSTANTIABLE, RUNTIME_PREFIXES
from quillgraph.operators.scan import RANGE, before, in_ranges

KEY = ["type_uri", "uri"]


def with_scope(log: DataFrame) -> DataFrame:
    """tier (M0 for runtime data, else M1) and, for M0, whether a command stays on its device."""
    runtime = F.coalesce(*[F.when(F.col("cmd_type").startswith(p), F.lit(True)) for p in RUNTIME_PREFIXES], F.lit(False))
    return log.withColumn("tier", F.when(runtime, "M0").otherwise("M1")).withColumn("scope", F.when(F.col("cmd_type").isin(*DEVICE_LOCAL), "device-local").when(runtime, "shared"))


def tail(commits: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Commits after the latest checkpoint of their map and branch (all, where there is none)."""
    heads = checkpoints.groupBy("map_id", "branch_id").agg(F.max("sequence").alias("_head"))
    return commits.join(heads, ["map_id", "branch_id"], "left").where(F.col("sequence") > F.coalesce("_head", F.lit(-1))).drop("_head")


def stable_ids(commands: DataFrame) -> DataFrame:
    """Commands that add without an id get one that every replay gives again."""
    made = F.sha2(F.concat_ws("|", "id", F.col("position").cast("string")), 256)
    return commands.withColumn("uri", F.when(F.col("cmd_type").endswith(":add") & F.col("uri").isNull(), made).otherwise(F.col("uri")))


def allowed(kind: Column, class_id: Column) -> Column:
    """Why a command is rejected whatever the state, or NULL."""
    return (
        F.when(class_id.isNull(), "unknown-type")
        .when(~class_id.isin(*INSTANTIABLE), "not-instantiable")
        .when(class_id.isin(*IMMUTABLE) & kind.isin("instance:update", "instance:delete"), "immutable")
    )


def _own(commits: DataFrame) -> DataFrame:
    return commits.where(F.col("cmd_type").isin("instance:upsert", "instance:update", "instance:delete"))


def judged(commits: DataFrame, rows: int = RANGE) -> DataFrame:
    """Instance commands with a reason where they are rejected. Whether a key is alive before a command depends on the last
    upsert or delete before it alone, since a delete of what isn't there changes nothing."""
    own = in_ranges(_own(commits).withColumn("_unfit", allowed(F.col("cmd_type"), F.col("class_id"))), "sequence", rows)
    turn = F.when(F.col("_unfit").isNull() & F.col("cmd_type").isin("instance:upsert", "instance:delete"), F.col("cmd_type"))
    met = before(own, KEY, "sequence", {"_turn": turn})
    absent = F.when(F.col("cmd_type").isin("instance:update", "instance:delete") & ~F.coalesce(F.col("_turn") == "instance:upsert", F.lit(False)), "absent")
    return met.withColumn("reason", F.coalesce("_unfit", absent)).drop("_unfit", "_turn")


def rejected(commits: DataFrame) -> DataFrame:
    return judged(commits).where("reason is not null")


def replay(commits: DataFrame, fields: str = "data") -> DataFrame:
    """type_uri, uri, data, created_at, updated_at of what is alive after all commands. An update's data take the place of the
    former ones as a whole (NULL: it gives none)."""
    return alive(live(commits, fields))


def live(commits: DataFrame, fields: str = "data") -> DataFrame:
    """A row per key: its last upsert and delete, the newest data and times. Maxima alone, so a stream may keep it too."""
    own = _own(commits).where(allowed(F.col("cmd_type"), F.col("class_id")).isNull())
    kind, at = F.col("cmd_type"), F.col("sequence")
    born, gone = F.when(kind == "instance:upsert", at), F.when(kind == "instance:delete", at)
    gives = F.when((kind == "instance:upsert") | (kind == "instance:update") & F.col(fields).isNotNull(), at)
    touches = F.when(kind != "instance:delete", at)
    # An update before the last upsert has a smaller sequence, so the newest of both is the state in any case.
    return own.groupBy(*KEY).agg(F.max(born).alias("_born"), F.max(gone).alias("_gone"), F.max_by(fields, gives).alias("data"), F.max_by("ts", born).alias("created_at"), F.max_by("ts", touches).alias("updated_at"))


def alive(newest: DataFrame) -> DataFrame:
    return newest.where("_born > coalesce(_gone, _born - 1)").drop("_born", "_gone")


def compact(commits: DataFrame, fields: str = "data") -> DataFrame:
    """Commands, in the same columns, that give the same state now and after any later commands: of every key the last upsert,
    the last delete, the last update and the last one that gives data."""
    own = _own(commits).where(allowed(F.col("cmd_type"), F.col("class_id")).isNull())
    kind = F.when((F.col("cmd_type") == "instance:update") & F.col(fields).isNull(), "touch").otherwise(F.col("cmd_type"))
    rest = [c for c in own.columns if c not in KEY]
    return own.groupBy(*KEY, kind.alias("_kind")).agg(F.max_by(F.struct(*rest), "sequence").alias("_row")).select(*KEY, "_row.*").select(*own.columns)


def domain_events(commits: DataFrame) -> DataFrame:
    """One event per accepted command; progress of runs and snapshots of simulations give none."""
    names = {"instance:upsert": "InstanceUpserted", "instance:update": "InstanceUpdated", "instance:delete": "InstanceDeleted"}
    name = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("cmd_type"))
    return judged(commits).where("reason is null").select("sequence", *KEY, name.alias("event"), "ts")


def inverse(commits: DataFrame, rows: int = RANGE) -> DataFrame:
    """sequence, type_uri, uri, inverse, data: the command that undoes each accepted one. An upsert is undone by the data
    before or a delete, an update by the data before (NULL where it gives none), a delete by an upsert of the data before."""
    own = judged(commits, rows).where("reason is null")
    kind = F.col("cmd_type")
    met = before(own, KEY, "sequence", {"_turn": F.when(kind != "instance:update", kind), "_was": F.when(kind != "instance:delete", F.col("data"))})
    alive = F.coalesce(F.col("_turn") == "instance:upsert", F.lit(False))
    back = F.when(kind == "instance:update", "instance:update").when(alive, "instance:upsert").otherwise("instance:delete")
    return met.select("sequence", *KEY, back.alias("inverse"), F.when(alive & ((kind != "instance:update") | F.col("data").isNotNull()), F.col("_was")).alias("data"))


def operations(log: DataFrame, opening: str, statuses: dict[str, str], counting: str | None = None) -> DataFrame:
    """Runs, retries, suppressions, deployments and the like (uri, cmd_type, sequence, ts): the state after the last
    opening command, its status by the last command since, and how often `counting` came since."""
    own = log.where(F.col("cmd_type").isin(opening, *statuses, *([counting] if counting else [])))
    opened = own.where(F.col("cmd_type") == opening).groupBy("uri").agg(F.max("sequence").alias("_from"), F.max_by("ts", "sequence").alias("opened_at"))
    since = own.join(opened, "uri").where("sequence >= _from")
    moved = F.when(F.col("cmd_type").isin(opening, *statuses), F.col("sequence"))
    state = since.groupBy("uri", "opened_at").agg(F.max_by("cmd_type", moved).alias("_last"), F.max("ts").alias("changed_at"), F.count_if(F.col("cmd_type") == counting if counting else F.lit(False)).alias("attempts"))
    status = F.element_at(F.create_map(*[F.lit(x) for pair in ({opening: "open"} | statuses).items() for x in pair]), F.col("_last"))
    return state.select("uri", status.alias("status"), "opened_at", "changed_at", "attempts")


def pipeline_health(runs: DataFrame, queue: DataFrame, retries: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Per pipeline: last completed sync, pending writebacks, open retries, whether it is suppressed."""
    last = runs.where("status = 'completed'").groupBy("pipeline").agg(F.max("changed_at").alias("last_sync"))
    pending = queue.where("status = 'open'").groupBy("pipeline").agg(F.count(F.lit(1)).alias("pending"))
    depth = retries.where("status = 'open'").groupBy("pipeline").agg(F.count(F.lit(1)).alias("retries"))
    quiet = suppressions.where("status = 'open'").select("pipeline").distinct().withColumn("suppressed", F.lit(True))
    names = runs.select("pipeline").union(queue.select("pipeline")).union(retries.select("pipeline")).union(suppressions.select("pipeline")).distinct()
    return names.join(last, "pipeline", "left").join(pending, "pipeline", "left").join(depth, "pipeline", "left").join(quiet, "pipeline", "left").na.fill(0, ["pending", "retries"]).na.fill(False, ["suppressed"])
