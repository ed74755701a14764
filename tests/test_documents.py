"""Whole documents with kinds nobody foresaw; measures as declared."""

from __future__ import annotations

import datetime
import json

from quillgraph.operators import triples, versions
from quillgraph.sources import documents
from quillgraph.streaming import streams

DOCUMENT = {
    "uri": "r", "name": "root", "meta": {"createdAt": "x"}, "facets": {"things": [{"uri": "t1", "name": "T", "tags": ["a"], "states": [{"id": "s1", "name": "S", "transitions": [{"targetStateId": "s2"}]}]}], "unknownKey": [{"uri": "u"}]},
    "customFacets": {"canvasNode": [{"uri": "n1", "x": 1.5, "deep": {"b": [1, None], "a": "é"}, "gone": None}], "risks": [{"uri": "k1", "name": "R", "tags": ["hot"]}]},
    "customTypes": [{"id": "Risk", "pluralKey": "risks"}], "symbols": [{"uri": "y", "content": "see @[A](entity:t1)"}],
    "contexts": {"c": {"uri": "c", "parentUri": "r", "name": "C", "tags": ["z"], "metadata": {"q": 1}, "customFacets": {"canvasNode": [{"uri": "n2", "x": 2}]}}},
    "links": [{"uri": "l", "predicate": "reads", "sourceUri": "t1", "targetUri": "y", "description": "d", "pattern": "p", "metadata": {"k": [1]}}, {"uri": "m", "predicate": "uses", "sourceUri": "t1", "targetUri": "n1"}],
}


def flat(spark, *bodies):
    return documents.flatten(spark.createDataFrame([(f"m{k}", b if b is None or isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "map_id string, body string"))


def test_flatten(spark):
    got = flat(spark, DOCUMENT)
    rows = {r.uri: r for r in got["entities"].collect()}
    assert set(rows) == {"t1", "n1", "k1", "y", "n2"}  # a facet key that no class has is no facet
    assert [(rows[u].class_id, rows[u].facet_key, rows[u].is_custom, rows[u].container_uri) for u in ("t1", "n1", "k1", "n2", "y")] == [
        ("Thing", "things", False, "r"), ("canvasNode", "canvasNode", True, "r"), ("Risk", "risks", True, "r"), ("canvasNode", "canvasNode", True, "c"), ("Symbol", "symbols", False, "r"),
    ]
    assert rows["n1"].fields == {"uri": '"n1"', "x": "1.5", "deep": '{"a":"é","b":[1,null]}', "gone": "null"}
    links = {r.uri: r for r in got["links"].collect()}
    assert (links["l"].description, links["l"].pattern, links["l"].metadata, links["m"].metadata) == ("d", "p", '{"k":[1]}', None)
    places = {r.uri: r for r in got["containers"].collect()}
    assert places["r"].parent_uri is None and places["c"].parent_uri == "r" and places["c"].fields["metadata"] == '{"q":1}' and "contexts" not in places["r"].fields


def test_bodies_that_say_nothing(spark):
    got = flat(spark, None, "", "not json", "[]", "{}", "3", {"uri": "r", "facets": None, "contexts": None, "links": None, "symbols": [None]})
    assert got["links"].count() == got["kinds"].count() == 0
    assert [r.uri for r in got["entities"].collect()] in ([], [None])


def test_custom_facets_in_versions(spark):
    moved = json.loads(json.dumps(DOCUMENT))
    moved["customFacets"]["canvasNode"][0]["x"] = 9
    gone = json.loads(json.dumps(DOCUMENT))
    gone["customFacets"]["risks"] = []
    gone["customFacets"]["canvasNode"][0]["deep"] = {"a": "é", "b": [1, None]}  # the same, keys in another order
    base, ours, theirs = (documents.snapshot(flat(spark, d)) for d in (DOCUMENT, moved, gone))
    assert [(r.uri, r.change_type, r.changed_fields) for r in versions.diff(base, ours).collect()] == [("n1", "modified", ["x"])]
    merged = {r.uri: r for r in versions.merge(base, ours, theirs).collect()}
    assert merged["k1"].outcome == "removed" and merged["n1"].outcome == "ours" and merged["n1"].row["x"] == "9"


def test_triples_of_all_kinds(spark):
    got = {(r.s, r.p, r.o) for r in triples.document_triples(flat(spark, DOCUMENT)).collect()}
    assert {("k1", "rdf:type", "bm:custom/Risk"), ("k1", "hasTag", "hot"), ("s1", "rdf:type", "bm:ThingState"), ("s1", "state:memberOf", "t1"), ("s1", "state:transitionsTo", "s2"), ("y", "mentions", "t1"), ("t1", "reads", "y"), ("c", "childOf", "r")} <= got
    assert not any(s in ("n1", "n2", "u") for s, _, _ in got)  # kinds that aren't declared give none


def test_windows_of_any_length(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    points = [("a", "x", at(h), float(h)) for h in range(48)] + [("b", "x", at(h), float(h % 2)) for h in range(24)] + [("a", "y", at(3), None), ("none", "x", at(1), 1.0)]
    measures = streams.measures_table(spark, {"a": {"aggregation": "percentile", "window": (1, "days"), "quantile": 0.5, "min": 10, "max": 20, "direction": "range"}, "b": {"aggregation": "ratio", "window": (12, "hours")}})
    rows = streams.declared_windows(streams.measure_parts(spark.createDataFrame(points, "measure_id string, dimension string, ts timestamp, value double")), measures).collect()
    assert sorted((r.measure_id, r.start, r.n, r.value, r.met) for r in rows) == [("a", at(0), 24, 11.0, True), ("a", at(24), 24, 35.0, False), ("b", at(0), 12, 0.5, None), ("b", at(12), 12, 0.5, None)]


def test_copies_under_fresh_ids(spark):
    document = json.loads(json.dumps(DOCUMENT))
    document["facets"]["things"][0]["attributes"] = [{"name": "a", "referencedThingId": "elsewhere"}, {"name": "b", "referencedThingId": ""}]
    document["facets"]["interfaces"] = [{"uri": "i", "attachments": [{"kind": "blob"}, {"kind": "url", "u": 1}]}, {"uri": "j", "attachments": [{"kind": "blob"}]}]
    document["customFacets"]["canvasNode"][0] |= {"representedBy": "t1"}
    document["customFacets"]["risks"][0] |= {"representedBy": "nobody", "attributes": [{"referencedThingId": "t1"}]}
    copy = documents.re_id(flat(spark, document), "s")
    import hashlib

    new = lambda x: "bm:" + hashlib.sha256(f"s|{x}".encode()).hexdigest()
    rows = {r.uri: r for r in copy["entities"].collect()}
    assert set(rows) == {new(x) for x in ("t1", "i", "j", "n1", "n2", "k1", "y")}
    fields = lambda x: {k: json.loads(v) for k, v in rows[new(x)].fields.items()}
    assert fields("t1")["attributes"] == [{"name": "a", "referencedThingId": new("elsewhere")}, {"name": "b", "referencedThingId": ""}]
    assert fields("t1")["states"] == [{"id": new("s1"), "name": "S", "transitions": [{"targetStateId": new("s2")}]}] and fields("t1")["uri"] == new("t1")
    assert fields("n1")["representedBy"] == new("t1") and fields("k1")["representedBy"] == "nobody" and fields("k1")["attributes"] == [{"referencedThingId": "t1"}]
    assert fields("i")["attachments"] == [{"kind": "url", "u": 1}] and "attachments" not in fields("j")
    assert {(r.uri, r.source_uri, r.target_uri) for r in copy["links"].collect()} == {(new("l"), new("t1"), new("y")), (new("m"), new("t1"), new("n1"))}
    assert {(r.uri, r.parent_uri) for r in copy["containers"].collect()} == {(new("r"), None), (new("c"), new("r"))}
