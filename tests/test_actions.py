"""Requests that see each other's effects, against a fold over requests; field conditions."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import actions, queues

RULES = "action string, step int, effect string, thing string, field string, source string, arg string, arg_thing string, predicate string, source_ref string, target_ref string"


def rule(action, step, effect, thing=None, field=None, source=None, arg=None, arg_thing=None, predicate=None, source_ref=None, target_ref=None):
    return (action, step, effect, thing, field, source, arg, arg_thing, predicate, source_ref, target_ref)


@pytest.mark.parametrize("size", [7, 1_000_000])
@pytest.mark.parametrize("queues_", [1, 4])
def test_queues(spark, size, queues_):
    draw = random.Random(size + queues_)
    held = [(f"q{k % queues_}", f"i{k:02d}") for k in range(3 * queues_)]
    state = {f"q{k}": deque(sorted(i for q, i in held if q == f"q{k}")) for k in range(queues_)}
    rows, wanted = [], {}
    for n in range(400):
        q, kind = f"q{draw.randrange(queues_)}", draw.choice(["push", "pop", "pop", "peek"] if n % 80 < 50 else ["push", "push", "peek", "pop"])
        rows.append((q, n, kind, f"n{n}" if kind == "push" else None))
        if kind == "push":
            state[q].append(f"n{n}")
            wanted[n] = None
        else:
            wanted[n] = (state[q].popleft() if kind == "pop" else state[q][0]) if state[q] else None
    found = queues.fifo(spark.createDataFrame(rows, "q string, at long, kind string, id string"), spark.createDataFrame(held, "q string, id string"), ["q"], "at", size)
    assert {r["at"]: r.taken for r in found.collect()} == wanted
    assert None in {wanted[n] for q, n, kind, _ in rows if kind == "pop"}


def test_later_requests_see_what_earlier_ones_did(spark):
    rules = spark.createDataFrame(
        [
            rule("add", 1, "create", "t", "x", "param", "v"), rule("add", 2, "create", "u", "y", "attribute", "x", "t"), rule("add", 3, "modify", "u", "z", "attribute", "y", "u"), rule("add", 4, "createLink", predicate="p", source_ref="s", target_ref="t"),
            rule("drop", 1, "delete", "t"), rule("drop", 2, "deleteLink", predicate="p", source_ref="s"), rule("drop", 3, "delete", "t"), rule("touch", 1, "modify", "t", "w", "time"), rule("touch", 1, "modify", "t", "v", "attribute", "x", "t"),
        ],
        RULES,
    )
    asked = spark.createDataFrame([(1, "drop", None, "a"), (2, "add", "5", "b"), (3, "touch", None, "c"), (4, "add", "6", "d"), (5, "drop", None, "e"), (6, "drop", None, "f")], "request long, action string, v string, ts string")
    asked = asked.select("request", "action", F.lit("me").alias("user"), F.map_filter(F.create_map(F.lit("v"), "v"), lambda _, v: v.isNotNull()).alias("params"), "ts")
    found = actions.effects(asked, rules, spark.createDataFrame([("t", "t0")], "thing string, id string"), spark.createDataFrame([("r0", "p", "s"), ("r1", "q", "s")], "id string, predicate string, source_id string"))
    assert sorted((r.request, r.step, r.effect, r.target or "", r.field or "", r.value) for r in found.collect()) == [
        (1, 1, "delete", "t0", "", None), (1, 2, "deleteLink", "s", "p", "r0"), (1, 3, "no-instance", "", "", None),
        (2, 1, "create", "new/2/1", "x", "5"), (2, 2, "create", "new/2/2", "y", "5"), (2, 3, "modify", "new/2/2", "z", "5"), (2, 4, "createLink", "s", "p", "new/2/1"),
        (3, 1, "modify", "new/2/1", "v", None), (3, 1, "modify", "new/2/1", "w", "c"),
        (4, 1, "create", "new/4/1", "x", "6"), (4, 2, "create", "new/4/2", "y", "6"), (4, 3, "modify", "new/4/2", "z", "6"), (4, 4, "createLink", "s", "p", "new/4/1"),
        (5, 1, "delete", "new/2/1", "", None), (5, 2, "deleteLink", "s", "p", "link/2/4"), (5, 3, "delete", "new/4/1", "", None),
        (6, 1, "no-instance", "", "", None), (6, 2, "deleteLink", "s", "p", "link/4/4"), (6, 3, "no-instance", "", "", None),
    ]


def test_field_conditions(spark):
    instances = spark.createDataFrame([("t", {"n": ("integer", "5"), "s": ("text", '"x"'), "nul": ("text", "null")}), ("t", {"n": ("integer", "7")})], "thing_id string, attributes map<string,struct<type: string, value: string>>")
    cases = [("a", "t", "n", "gt", "6", True), ("b", "t", "n", "gt", "7", False), ("c", "t", "s", "equals", "x", True), ("d", "t", "s", "equals", "y", False), ("e", "t", "s", "exists", None, True), ("f", "t", "nul", "exists", None, False), ("g", "u", "n", "exists", None, False), ("h", "t", "n", "lt", "6", True), ("i", "t", "gone", "gt", "-1", False), ("j", "t", "nul", "lt", "1", True)]
    found = actions.fields_ready(instances, spark.createDataFrame([c[:5] for c in cases], "action string, thing string, attribute string, operator string, value string"))
    assert {r.action: r._fit for r in found.collect()} == {c[0]: c[5] for c in cases}
