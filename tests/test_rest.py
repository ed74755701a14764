"""Small cases of bulk edits, triples of what happened, and what a part touches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import graph, triples, versions


def test_removing_what_is_there_and_what_is_not(spark):
    entities = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a")], "map_id string, uri string")
    links = spark.createDataFrame([("m", "1", "a", "b"), ("m", "2", "b", "b"), ("n", "3", "a", "a"), ("m", "4", "x", "b"), ("m", "5", "a", "a")], "map_id string, uri string, source_uri string, target_uri string")
    gone = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "x")], "map_id string, uri string")
    left, kept, pruned = versions.remove_entities(entities, links, gone)
    assert sorted(map(tuple, left.collect())) == [("m", "b"), ("n", "a")]
    assert sorted(r.uri for r in kept.collect()) == ["2", "3", "4"] and sorted(r.uri for r in pruned.collect()) == ["1", "5"]


def test_notes_become_contexts(spark):
    notes = spark.createDataFrame([("m", "s1", "One\ntwo\n"), ("m", "s2", None)], "map_id string, uri string, content string")
    links = spark.createDataFrame([("m", "1", "s1", "b"), ("m", "2", "s2", "b")], "map_id string, uri string, source_uri string, target_uri string")
    choices = spark.createDataFrame([("m", "s1", "c")], "map_id string, uri string, parent_uri string")
    none = F.lit(None).cast("string")
    made, left, kept, pruned = versions.classify_as_contexts(notes, links, choices, text.symbol_name(none, F.col("content")), text.symbol_description(none, F.col("content")))
    row = made.first()
    assert (row.parent_uri, row.name, row.description, row.from_uri) == ("c", "One", "two", "s1") and row.uri.startswith("bm:ctx:")
    assert [r.uri for r in left.collect()] == ["s2"] and [r.uri for r in kept.collect()] == ["2"] and [r.uri for r in pruned.collect()] == ["1"]


def test_descriptions(spark):
    rows = spark.createDataFrame([("L", "a\nb"), ("", "a\n\n b \n"), (None, "a"), (None, None), ("L", None)], "label string, content string")
    assert [r.d for r in rows.select(text.symbol_description(F.col("label"), F.col("content")).alias("d")).collect()] == ["a\nb", "b", "", "", ""]


def test_what_happened(spark):
    events = spark.createDataFrame([("e1", "ev", "t", None), ("e2", "ev", "t", "act")], "id string, event_id string, occurred_at string, source_action_id string")
    points = spark.createDataFrame([("m", "t", 1.5, {"d": "x"}), ("m", "u", 2.0, None)], "measure_id string, ts string, value double, dimensions map<string,string>")
    got = {tuple(r) for r in triples.occurrence_triples(events).unionByName(triples.measure_triples(points)).collect()}
    assert ("event-occurrence/e2", "triggeredBy", "act") in got and len([t for t in got if t[1] == "triggeredBy"]) == 1
    assert ("measure-point/m/t", "dimension/d", "x") in got and ("measure-point/m/u", "value", "2.0") in got and len(got) == 7 + 5 + 4


def test_impact(spark):
    links = spark.createDataFrame([("m", "p", "a", "b"), ("m", "q", "c", "a"), ("m", "p", "b", "d"), ("m", "r", "a", "b")], "map_id string, predicate string, source_uri string, target_uri string")
    owners = spark.createDataFrame([("m", "b", "k1"), ("m", "c", "k1"), ("m", "d", "k2")], "map_id string, id string, container_uri string")
    rows = graph.impact_report(spark.createDataFrame([("m", "a")], "map_id string, id string"), links, owners, 5).collect()
    of = lambda kind: sorted((r.id, r.predicate, r.depth) for r in rows if r.kind == kind)
    assert of("direct") == [("b", "p", 1), ("b", "r", 1), ("c", "q", 1)] and of("transitive") == [("b", None, 1), ("c", None, 1), ("d", None, 2)]
    assert of("container") == [("k1", None, 2), ("k2", None, 1)] and of("total") == [(None, None, 3)]


def test_items_of_lists(spark):
    rows = spark.createDataFrame([("u", "- a\n- \n\n1. x\n- [x] t\n- [ ] v\nplain\n- b")], "uri string, content string")
    got = sorted(map(tuple, text.item_triples(text.blocks(rows)).collect()))
    assert got == sorted([
        ("u#0/0", "blockType", "listItem"), ("u#0/0", "blockText", "a"), ("u#0/1", "blockType", "listItem"), ("u#2/0", "blockType", "listItem"), ("u#2/0", "blockText", "x"),
        ("u#3/0", "blockType", "taskItem"), ("u#3/0", "blockText", "t"), ("u#3/0", "blockChecked", "true"), ("u#3/1", "blockType", "taskItem"), ("u#3/1", "blockText", "v"), ("u#3/1", "blockChecked", "false"),
        ("u#5/0", "blockType", "listItem"), ("u#5/0", "blockText", "b"),
    ])
