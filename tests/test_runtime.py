"""Logs of all command kinds against a fold over commands; tables that streams keep."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.vocab import RUNTIME_COMMANDS
from quillgraph.operators import log, runtime, scan
from quillgraph.sources.files import scratch
from quillgraph.streaming import streams

SCHEMA = "sequence long, ts timestamp_ntz, cmd_type string, type_uri string, class_id string, uri string, changes map<string,string>"


def fold(rows):
    """What the commands do one after the other: reasons, events, inverses."""
    state, reasons, events, inverses = {}, {}, {}, {}
    for n, ts, cmd, type_uri, class_id, uri, changes in rows:
        spec, family = RUNTIME_COMMANDS.get(cmd), cmd.split(":")[0]
        if spec is None:
            reasons[n] = "unknown-command"
            continue
        turn, key = spec["turn"], (family, type_uri if family == "instance" else None, uri)
        reason = None
        if turn == "open":
            if family == "instance" and class_id is None:
                reason = "unknown-type"
            elif family == "instance" and class_id == "Port":
                reason = "not-instantiable"
            elif uri is None:
                reason = "no-uri"
        elif turn != "free":
            if family == "instance" and class_id == "Event":
                reason = "immutable"
            elif key not in state:
                reason = "absent"
        if reason:
            reasons[n] = reason
            continue
        if "event" in spec:
            events[n] = (uri, spec["event"])
        old = state.get(key)
        stamp = {spec["stamp"]: json.dumps(ts.strftime("%Y-%m-%d %H:%M:%S"))} if "stamp" in spec else {}
        if turn == "open":
            inverses[n] = ("instance:upsert", dict(old)) if family == "instance" and old is not None else (spec["inverse"], {})
            state[key] = dict(changes)
        elif turn == "free":
            inverses[n] = (spec["inverse"], changes)
        elif turn == "delete":
            inverses[n] = (spec["inverse"], dict(state.pop(key)))
        elif turn == "status":
            inverses[n] = (spec["inverse"], dict(old))
            state[key] = old | {"status": json.dumps(spec["status"])} | stamp
            if cmd == "writebackQueue:fail":
                state[key] |= changes
                if "attemptCount" in old:
                    state[key]["attemptCount"] = str(int(old["attemptCount"]) + 1)
        else:
            back = {k: old.get(k) for k in changes}
            if cmd == "pipelineRun:complete":
                back = {"status": old.get("status") if old.get("status") in ('"completed"', '"failed"') else '"completed"'}
            elif cmd == "pipelineRun:progress":
                back = {k: old.get(k, "0") for k in ("recordsProcessed", "recordsFailed")}
            elif cmd == "simRun:snapshot":
                back = {"snapshotUri": old.get("snapshotUri", '""')}
            inverses[n] = (spec["inverse"], back)
            state[key] = old | changes | stamp
    return reasons, events, inverses


def commands(seed, n, keys):
    import datetime

    draw = random.Random(seed)
    rows = []
    for k in range(n):
        cmd = draw.choice([*RUNTIME_COMMANDS, "instance:rename"])
        family, turn = cmd.split(":")[0], RUNTIME_COMMANDS.get(cmd, {}).get("turn")
        changes = {}
        if turn == "open":
            changes = {"status": '"new"', "amount": str(k)}
            if family == "writebackQueue":
                changes["attemptCount"] = str(draw.randint(0, 3))
            if family == "instance":
                changes["data"] = f'{{"n":{k}}}'
        elif cmd == "instance:update":
            changes = {f: str(k) for f in draw.sample(["data", "externalId", "sourceUri"], draw.randint(0, 2))}
        elif cmd == "pipelineRun:progress":
            changes = {"recordsProcessed": str(k), "recordsFailed": str(k % 7)}
        elif cmd == "pipelineRun:complete":
            changes = {"status": draw.choice(['"completed"', '"failed"'])} | ({"error": '"lost"'} if draw.random() < 0.3 else {})
        elif cmd == "deployment:update":
            changes = {f: f'"{k}"' for f in draw.sample(["target", "environment", "modelVersion"], draw.randint(1, 2))}
        elif cmd == "simRun:snapshot":
            changes = {"snapshotUri": f'"{k}"'}
        elif cmd == "writebackQueue:fail":
            changes = {"lastError": f'"{k}"'}
        elif turn == "free":
            changes = {"predicate": '"knows"', "target": f'"{k}"'}
        uri = None if turn == "open" and draw.random() < 0.05 else f"u{draw.randrange(keys)}"
        kind = draw.choice(["Thing", "Thing", "Thing", "Event", "Port", None]) if family == "instance" else None
        rows.append((k * 3, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k), cmd, {"Thing": "t", "Event": "e", "Port": "p", None: "x"}[kind] if family == "instance" else None, kind, uri, changes))
    return rows


@pytest.mark.parametrize(("keys", "size"), [(1, 40), (5, 1_000_000), (30, 97)])
def test_all_commands(spark, keys, size):
    """One key that holds all commands, over many ranges; several keys in one; many over a few."""
    rows = commands(keys, 900, keys)
    reasons, events, inverses = fold(rows)
    made = spark.createDataFrame(rows, SCHEMA)
    assert {r.sequence: r.reason for r in runtime.rejections(made, size).collect()} == reasons
    assert {r.sequence: (r.uri, r.event) for r in runtime.events(made, size).collect()} == events
    found = {r.sequence: (r.inverse, r.changes) for r in runtime.inverses(made, size).collect()}
    assert found == inverses
    assert {inverse for inverse, _ in inverses.values()} <= set(RUNTIME_COMMANDS)


def test_no_commands(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert runtime.rejections(none).count() == runtime.events(none).count() == runtime.inverses(none).count() == 0


def test_no_window_over_a_whole_key(spark):
    """The windows over rows are by range, too; the only window by key is over one row a range."""
    rows = scan.in_ranges(spark.range(100).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.col("id").alias("v")), "at", 10)
    assert rows.select("_range").distinct().count() == 10
    found = scan.before(rows, ["key"], "at", {"last": F.when(F.col("v") % 7 == 0, F.col("v"))}, {"total": F.col("v")})
    got = {r.at: (r["last"], r.total) for r in found.collect()}
    assert got == {n: (max((k for k in range(n) if k % 7 == 0), default=None), n * (n - 1) // 2) for n in range(100)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "_range" not in line.split("], [")[1]:
            assert "_t_" in line  # over transitions only


# Tables that streams keep.
def landed(spark, path, batches):
    """A file a batch, in order of their names."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "key long, v long, record_index long").coalesce(1).write.mode("append").parquet(f"{path}/in-{n:03d}")
    return "key long, v long, record_index long"


def arriving(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in-*")


def rows_in(path):
    import pyarrow.parquet as pq

    return sum(pq.read_metadata(f"{path}/{f}").num_rows for f in os.listdir(path) if f.endswith(".parquet"))


def test_batches_write_what_they_touch(spark):
    source, out, checkpoint = scratch(spark, "in"), scratch(spark, "table"), scratch(spark, "progress")
    batches = [[(k, 0, k) for k in range(4000)]] + [[(10 * n + k, n, k) for k in range(10)] for n in range(1, 21)]
    schema = landed(spark, source, batches)
    streams.pipeline(arriving(spark, source, schema), lambda rows: rows, out, checkpoint, ["key"]).awaitTermination()
    assert streams.runs(spark, out) == [(0, 7), (8, 15), *[(n, n) for n in range(16, 21)]]
    written = {r: rows_in(f"{out}/run={r[0]}-{r[1]}") for r in streams.runs(spark, out)}
    assert written[(0, 7)] == 4000
    assert written[(8, 15)] == 80
    assert all(written[(n, n)] == 10 for n in range(16, 21))
    expected = {k: 0 for k in range(4000)} | {10 * n + k: n for n in range(1, 21) for k in range(10)}
    assert {r.key: r.v for r in streams.newest(spark, out, ["key"]).collect()} == expected
    # What comes later is taken up where the stream ended.
    spark.createDataFrame([(5, 99, 0), (5, 98, 1)], schema).coalesce(1).write.parquet(f"{source}/in-900")
    streams.pipeline(arriving(spark, source, schema), lambda rows: rows, out, checkpoint, ["key"], trigger={"processingTime": "0 seconds"}).processAllAvailable()
    for running in spark.streams.active:
        running.stop()
    assert {r.key: r.v for r in streams.newest(spark, out, ["key"]).collect()} == expected | {5: 98}


def test_a_batch_run_again_writes_the_same(spark):
    out = scratch(spark, "table")
    order = [streams.TURN, "record_index"]
    for n in [*range(8), 7, 7, 8]:  # batch 7 merges eight runs, and is run three times
        rows = spark.createDataFrame([(k, n, k) for k in range(n, n + 3)], "key long, v long, record_index long").withColumn(streams.TURN, F.lit(n).cast("long"))
        before = streams.runs(spark, out, n - 1)
        streams.drop_runs(spark, out, before, n)
        held = [r for r in before if r[0] >= 0] if n == 7 else []
        rows = rows.unionByName(streams._rows(spark, out, held)) if held else rows
        streams._last(rows, ["key"], order).write.mode("overwrite").parquet(f"{out}/run={0 if n == 7 else n}-{n}")
        if n == 7:
            assert len(before) == 7
    assert streams.runs(spark, out) == [(0, 7), (8, 8)]
    assert {r.key: r.v for r in streams.newest(spark, out, ["key"]).collect()} == {k: min(k, 8) for k in range(11)}


def test_live_state_holds_keys_in_the_state_store(spark):
    draw = random.Random(4)
    rows = [(n, f"instance:{draw.choice(['upsert', 'update', 'update', 'delete'])}", "t", "Thing", f"u{draw.randrange(6)}", {"v": str(n)}, n) for n in range(300)]
    schema = "sequence long, cmd_type string, type_uri string, class_id string, uri string, data map<string,string>, ts long"
    source, out, checkpoint = scratch(spark, "in"), scratch(spark, "state"), scratch(spark, "progress")
    late = rows[100:200] + rows[:100] + rows[200:]  # files out of order: the sequence decides
    for n in range(6):
        spark.createDataFrame(late[50 * n : 50 * n + 50], schema).coalesce(1).write.parquet(f"{source}/in-{n}")
    streams.state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/in-*"), out, checkpoint).awaitTermination()
    plain = lambda df: sorted((r.uri, sorted(r.data.items()), r.created_at, r.updated_at) for r in df.collect())
    assert plain(streams.state_of(spark, out)) == plain(log.replay(spark.createDataFrame(rows, schema)))
