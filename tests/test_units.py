"""Hand-made cases: coercions, mappings, versions, logs, texts, walks, streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import json_text, paths, text, vocab
from quillgraph.functions.transforms import Registry
from quillgraph.operators import actions, graph, joins, log, mapping, quality, sets, triples, versions
from quillgraph.sources import files
from quillgraph.streaming import streams


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def fields(spark, **values):
    pairs = ", ".join(f"('{k}', '{v}')" for k, v in values.items())
    return spark.sql(f"SELECT map_from_entries(collect_list(struct(k, v))) AS fields, array('a', 'b') AS tags FROM VALUES {pairs} AS t(k, v)")


@pytest.fixture(scope="module")
def row(spark):
    return fields(spark, n="5", s='"5"', t='"abc"', z="null", e='""', f="false", o="0", l="[]", d="1.0").cache()


@pytest.mark.parametrize(
    "name, op, value, want",
    [
        ("n", "eq", 5, True), ("s", "eq", 5, False), ("s", "eq", "5", True), ("d", "eq", 1, True), ("x", "eq", 5, False), ("x", "neq", 5, True), ("z", "eq", None, True), ("x", "eq", None, False),
        ("f", "eq", False, True), ("n", "gt", 4, True), ("n", "lte", 5, True), ("t", "gt", 5, True), ("z", "lt", "a", True), ("t", "gte", "abc", True), ("x", "gt", "", False), ("x", "lte", "", True),
    ],
)
def test_compare(row, name, op, value, want):
    assert one(row.select(sets.compare(name, op, value).alias("r"))).r is want


def test_filters_are_two_valued(row):
    tests = [~sets.compare("x", "gt", 1), ~sets.text_test("x", "contains", "a"), ~sets.one_of("x", [1]), sets.all_of(), ~sets.any_of(), sets.is_null("z"), sets.is_null("x"), ~sets.is_null("e"), ~sets.text_test("n", "contains", "5"), sets.text_test("t", "regex", "b."), sets.has_tag("a"), ~sets.has_tag("c")]
    assert all(one(row.select(*[t.alias(f"t{k}") for k, t in enumerate(tests)])))


def test_truthiness_and_blanks(row):
    seen = one(row.select(*[json_text.truthy(json_text.field(k)).alias(k) for k in "nstzefolx"]))
    assert seen.asDict() == {"n": True, "s": True, "t": True, "z": False, "e": False, "f": False, "o": False, "l": True, "x": False}
    blank = one(row.select(*[json_text.is_blank(json_text.field(k)).alias(k) for k in "nzelx"]))
    assert blank.asDict() == {"n": False, "z": True, "e": True, "l": True, "x": True}


def test_aggregates_of_nothing(spark, row):
    none = row.where("false")
    assert [one(sets.aggregate(none, op, "n")).value for op in ("count", "sum", "avg", "min", "max", "countDistinct")] == [0.0] * 6
    assert {r.group for r in sets.aggregate(row, "count", by="z").collect()} == {"unknown"}


def test_paths(spark):
    record = spark.sql("""SELECT parse_json('{"a": {"b": null, "c d": 1}, "s": "x", "n": 1.5}') AS v""")
    seen = [one(record.select(paths.value_at(F.col("v"), p).alias("r"))).r for p in ("$.a.b", "$.a.x", "a.c d", "s", "n", "7", '"q"', "true", "null")]
    assert seen == ["null", None, "1", '"x"', "1.5", "7", '"q"', "true", "null"]


RECORDS = """{"data": [{"id": 1, "email": "a@x", "live": true, "meta": {"tier": "gold"}, "card": "c1"}, {"id": "2", "email": null, "live": 1, "card": null},
  {"id": null, "email": "c@x", "live": true}, {"id": "4", "live": true}, {"id": "5", "email": "e@x", "live": ""}]}"""


def test_mapping_cases(spark):
    spec = mapping.Mapping("customer", "$.id", {"email": mapping.Field("$.email"), "tier": mapping.Field("$.meta.tier", "upper", '"NONE"')}, "$.data", "$.live", {"has": ("card", "$.card")})
    responses = spark.createDataFrame([(RECORDS,)], "body string")
    rows = {r.record_index: r for r in mapping.run_mapping(mapping.iterate(responses, spec.iterate), spec).collect()}
    assert [rows[k].status for k in range(5)] == ["ok", "ok", "error", "error", "skipped"]
    assert rows[0].external_id == "1" and rows[0].fields == {"email": '"a@x"', "tier": '"GOLD"'} and len(rows[0].links) == 1
    assert rows[1].fields == {"email": "null", "tier": '"NONE"'} and rows[1].links == []
    assert (rows[2].error_field, rows[3].error_field, rows[3].reason) == ("identity", "email", "missing")
    again = mapping.run_mapping(mapping.iterate(responses, spec.iterate), spec).collect()
    assert sorted(again, key=lambda r: r.record_index) == [rows[k] for k in range(5)]
    counts = {path: mapping.iterate(responses, path).count() for path in (None, "$.none", "$.data")}
    assert counts == {None: 1, "$.none": 0, "$.data": 5}


def test_unknown_transform_is_an_error_row(spark):
    spec = mapping.Mapping("t", "id", {"x": mapping.Field("id", "nope")})
    rows = mapping.run_mapping(spark.sql("SELECT 0 AS record_index, parse_json('{\"id\": \"a\"}') AS record"), spec)
    assert (one(rows).status, one(rows).reason) == ("error", "unknown transform nope")


def test_registry():
    registry = Registry()
    with pytest.raises(KeyError):
        registry.call("nope")
    registry.register("needs", lambda x, **named: x, required=("p",))
    with pytest.raises(ValueError):
        registry.call("needs", F.lit("1"))
    registry.register("loop", lambda x: registry.call("loop", x))
    with pytest.raises(RecursionError):
        registry.call("loop", F.lit("1"))


def test_python_transform_failures_are_null(spark):
    registry = Registry()
    registry.register_python("half", lambda x: str(int(x) / 2))
    rows = spark.sql("SELECT x FROM VALUES ('4'), ('oops'), (null) AS t(x)").select(registry.call("half", F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == ["2.0", None, None]


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "type_uri string, external_id string, v int")
    batch = spark.createDataFrame([("t", "b", 3, 1), ("t", "b", 4, 2), ("t", "c", 5, 1), ("t", None, 9, 1)], "type_uri string, external_id string, v int, n int")
    once = mapping.upsert(target, batch, ["n"])
    want = {("a", 1), ("b", 4), ("c", 5)}
    assert {(r.external_id, r.v) for r in once.collect()} == want
    assert {(r.external_id, r.v) for r in mapping.upsert(once, batch, ["n"]).collect()} == want


def test_guard(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'simulation', null, null, null), (2, 'simulation', null, 'simulation', null), (3, 'simulation', null, 'prod', true), (4, null, 'simulation', 'prod', false), (5, null, null, 'prod', false) AS t(id, pipeline_env, source_env, target_env, target_accepts)")
    allowed, wrong = mapping.guard(rows)
    assert sorted(r.id for r in allowed.collect()) == [2, 3, 5] and sorted(r.id for r in wrong.collect()) == [1, 4]


def snapshot(spark, rows):
    return spark.createDataFrame([("facet", u, c, "Thing", n, f) for u, c, n, f in rows], "kind string, uri string, container_uri string, class_id string, name string, fields map<string,string>")


BASE = [("a", "c1", "A", {"x": "1", "y": "1"}), ("b", "c1", "B", {"x": "1"}), ("c", "c1", "C", {}), ("d", "c1", "D", {"x": "1"})]


def test_merge_cases(spark):
    base = snapshot(spark, BASE)
    ours = snapshot(spark, [("a", "c2", "A", {"x": "2", "y": "1"}), ("b", "c1", "B", {"x": "2"}), ("d", "c1", "D", {"x": "1"}), ("n", "c1", "N", {})])
    theirs = snapshot(spark, [("a", "c1", "A", {"x": "1", "y": "3", "z": "9"}), ("b", "c1", "B", {"x": "3"}), ("c", "c1", "C", {"w": "1"}), ("n", "c1", "M", {})])
    rows = {r.uri: r for r in versions.merge(base, ours, theirs).collect()}
    assert {u: r.outcome for u, r in rows.items()} == {"a": "merged", "b": "conflict", "c": "conflict", "d": "removed", "n": "conflict"}
    assert rows["a"].row == {"containerId": "c2", "facetType": "Thing", "name": "A", "x": "2", "y": "3", "z": "9"}
    assert rows["b"].conflict_fields == ["x"] and rows["d"].row is None
    sides = spark.createDataFrame([("facet", "b", "theirs"), ("facet", "c", "ours")], "kind string, uri string, side string")
    done = {r.uri: (r.outcome, r.row) for r in versions.resolve(versions.merge(base, ours, theirs), sides).collect()}
    assert done["b"][1]["x"] == "3" and done["c"] == ("removed", None) and done["n"][0] == "conflict"


def test_merge_with_the_base_changes_nothing(spark):
    base, other = snapshot(spark, BASE), snapshot(spark, [("a", "c1", "A2", {"x": "5"}), ("z", "c1", "Z", {})])
    merged = versions.merge(base, other, base).where("row is not null")
    assert {r.uri: r.row for r in merged.collect()} == {r.uri: r.row for r in versions.whole(other).collect()}
    assert versions.diff(base, base).count() == 0
    there = versions.apply_changes(versions.whole(base), versions.diff(base, other))
    back = versions.apply_changes(there, versions.reverse(versions.diff(base, other)))
    assert {r.uri: r.row for r in back.collect()} == {r.uri: r.row for r in versions.whole(base).collect()}


def commands(spark, rows):
    return spark.createDataFrame([("t", u, k, n, c, d, n) for n, (u, k, c, d) in enumerate(rows)], "type_uri string, uri string, cmd_type string, sequence long, class_id string, data map<string,string>, ts long")


COMMANDS = [
    ("a", "instance:update", "Thing", {"x": "0"}), ("a", "instance:upsert", "Thing", {"x": "1", "y": "1"}), ("a", "instance:update", "Thing", {"x": "2"}), ("a", "instance:delete", "Thing", {}), ("a", "instance:delete", "Thing", {}),
    ("a", "instance:upsert", "Thing", {"y": "7"}), ("a", "instance:update", "Thing", {"z": "8"}), ("m", "instance:upsert", "Measure", {"v": "1"}), ("m", "instance:update", "Measure", {"v": "2"}), ("p", "instance:upsert", "Port", {}), ("q", "instance:upsert", None, {}),
]


def test_replay_and_inverse(spark):
    rows = commands(spark, COMMANDS)
    state = {r.uri: r.data for r in log.replay(rows).collect()}
    assert state == {"a": {"z": "8"}, "m": {"v": "1"}}  # an update's data replace the former ones as a whole
    assert {r.sequence: r.reason for r in log.rejected(rows).collect()} == {0: "absent", 4: "absent", 8: "immutable", 9: "not-instantiable", 10: "unknown-type"}
    inverse = {r.sequence: (r.inverse, r.data) for r in log.inverse(rows).collect()}
    assert inverse == {1: ("instance:delete", None), 2: ("instance:update", {"x": "1", "y": "1"}), 3: ("instance:upsert", {"x": "2"}), 5: ("instance:delete", None), 6: ("instance:update", {"y": "7"}), 7: ("instance:delete", None)}
    for cut in range(len(COMMANDS)):  # undoing the last accepted command gives the state before it
        if cut in inverse:
            kind, data = inverse[cut]
            undone = log.replay(commands(spark, [*COMMANDS[: cut + 1], (COMMANDS[cut][0], kind, "Thing" if kind == "instance:delete" else COMMANDS[cut][2], data or {})]))
            before = {r.uri: r.data for r in log.replay(commands(spark, COMMANDS[:cut])).collect()} if cut else {}
            assert {r.uri: r.data for r in undone.collect()} == before, cut


def test_log_tail_without_checkpoint(spark):
    commits = spark.createDataFrame([("m", "b", 1), ("m", "b", 2), ("n", "b", 1)], "map_id string, branch_id string, sequence long")
    marks = spark.createDataFrame([("m", "b", 1)], "map_id string, branch_id string, sequence long")
    assert sorted((r.map_id, r.sequence) for r in log.tail(commits, marks).collect()) == [("m", 2), ("n", 1)]


def test_text_round_trip(spark):
    source = "# One\n\nplain\nmore\n- a\n- b\n1. x\n2. y\n> q\n> r\n---\n- [x] t\n- [ ] u\n```sql\nselect 1\n```\n```\nopen"
    rows = spark.createDataFrame([("u", source), ("e", "")], "uri string, content string")
    found = text.blocks(rows)
    kinds = [r.block_type for r in found.where("uri = 'u'").orderBy("block_index").collect()]
    assert kinds == ["heading", "paragraph", "paragraph", "bullet", "ordered", "quote", "rule", "task", "code", "code"]
    back = {r.uri: r.content for r in text.blocks_to_text(found).collect()}
    assert back == {"u": source + "\n```", "e": ""}
    assert {r.uri: r.content for r in text.blocks_to_text(text.blocks(spark.createDataFrame([("u", back["u"])], "uri string, content string"))).collect()}["u"] == back["u"]


def test_no_heading_beyond_three(spark):
    rows = text.blocks(spark.createDataFrame([("u", "#### four\n--\n-no")], "uri string, content string")).collect()
    assert [(r.block_type, r.text) for r in rows] == [("paragraph", "#### four\n--\n-no")]


def test_mentions(spark):
    rows = spark.createDataFrame([("u", "a @[Thing:X:1] b @[P:Y:2:c] @[Old](thing:3) é @[Bad @[Thing:Z:4]](thing:5)")], "uri string, content string")
    got = [(r.start, r.kind, r.label, r.id, r.context) for r in text.mentions(rows).orderBy("start").collect()]
    assert got[:3] == [(3, "Thing", "X", "1", None), (18, "P", "Y", "2", "c"), (29, "thing", "Old", "3", None)]
    assert [g[3] for g in got] == ["1", "2", "3", "4"]
    assert text.mentions(rows.select("uri", F.lit(None).cast("string").alias("content"))).count() == 0


def test_walks(spark):
    links = spark.createDataFrame([("m", f"l{k}", p, s, t) for k, (p, s, t) in enumerate([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("q", "b", "d"), ("p", "e", "e")])], "map_id string, uri string, predicate string, source_uri string, target_uri string")
    start = spark.createDataFrame([("m", "a")], "map_id string, id string")
    walk = lambda *x: {(r.id, r.depth) for r in graph.traverse(start, links, *x).collect()}
    assert walk("p", "out", 5) == {("b", 1), ("c", 2)} and walk("*", "out", 2) == {("b", 1), ("c", 2), ("d", 2)}
    assert walk("p", "in", 1) == {("c", 1)} and walk("p", "both", 1) == {("b", 1), ("c", 1)} and walk("none", "out", 3) == set()
    edges = links.select(F.col("source_uri").alias("src"), F.col("target_uri").alias("dst"))
    assert {r.id for r in graph.cyclic_nodes(edges).collect()} == {"a", "b", "c", "e"}
    tree = {(r.node, r.ancestor, r.depth) for r in graph.closure(spark.createDataFrame([("x", "y"), ("y", "z")], "node string, up string")).collect()}
    assert tree == {("x", "y", 1), ("y", "z", 1), ("x", "z", 2)}


def test_constraints(spark):
    test = quality.constraint_fault
    seen = lambda value, **limits: one(spark.createDataFrame([(value,)], "v string").select(test(F.col("v"), **limits).alias("r"))).r
    assert seen('"a@b.c"', value_type="email") is None and seen('"nope"', value_type="email") == "regex" and seen("null", value_type="email") is None and seen(None, value_type="email") is None
    assert seen("7", value_type="rating-5") == "range" and seen('"4"', value_type="rating-5") is None and seen('"DEU"', value_type="country-code") in ("regex", "length") and seen('"x"', enum=["y"]) == "enum"


def test_turtle_groups_and_escapes(spark):
    rows = spark.createDataFrame([("a b", "rdf:type", "bm:Thing"), ("a b", "rdfs:label", 'say "hi"\n'), ("a b", "p:q:r", "x")], "s string, p string, o string")
    value = one(triples.turtle(rows)).value
    assert value.startswith("<https://quillgraph.example/entity/a%20b> a <https://quillgraph.example/vocab/Thing> ;") and '"say \\"hi\\"\\n"' in value and "vocab/p_q:r>" in value and value.endswith(" .")
    assert one(triples.ntriples(spark.createDataFrame([("s", "p", "http://x")], "s string, p string, o string"), True)).value.endswith("<http://x> .")


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnull\n{oops\n[2]\n')
    (tmp_path / "b.csv").write_text('x,y\n 1 , "q" \n\n2\n')
    assert [r.body for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()] == ['{"a": 1}', "[2]"]
    assert [(r.x, r.y) for r in files.read_csv(spark, str(tmp_path / "b.csv"), ["x", "y"]).collect()] == [("1", '"q"'), ("2", "")]
    assert [files.format_of(p) for p in ("a.JSON", "b.ndjson", "c.csv", "d.md")] == ["json", "jsonl", "csv", "text"]


def test_links_checks(spark):
    class Tiny:
        contexts = spark.createDataFrame([("m", "c", None, "C")], "map_id string, uri string, parent_uri string, name string")
        entities = spark.createDataFrame([("m", "t", "Thing", "c", "T"), ("m", "p", "Persona", "c", "P"), ("m", "a", "Action", "c", "A")], "map_id string, uri string, class_id string, container_uri string, name string").withColumn("fields", F.create_map().cast("map<string,string>"))
        symbols = entities.where("false")

    Tiny.spark = spark
    rows = [("performs", "p", "a"), ("performs", "a", "p"), ("performs", "p", "t"), ("extends", "t", "a"), ("nope", "t", "a"), ("owns", "t", "t"), ("owns", "t", "gone"), ("owns", "gone", "t")]
    links = spark.createDataFrame([("m", str(k), *r) for k, r in enumerate(rows)], "map_id string, uri string, predicate string, source_uri string, target_uri string")
    got = {int(r.uri): r.fault for r in joins.validate_links(links, Tiny).collect()}
    assert got == {0: None, 1: "domain", 2: "range", 3: "extends-class", 4: "unknown-predicate", 5: "self-link", 6: "target-missing", 7: "source-missing"}


def test_late_points_are_dropped(spark, tmp_path):
    points = lambda *ts: spark.createDataFrame([("m", "d", t, 1.0) for t in ts], "measure_id string, dimension string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (("2024-01-01 00:10", "2024-01-01 05:00"), ("2024-01-01 00:20", "2024-01-01 06:00"), ("2024-01-01 09:00",)):
        points(*part).coalesce(1).write.mode("append").parquet(source)
        stream = streams.measure_windows(streams.files(spark, source, "measure_id string, dimension string, ts timestamp, value double"), "1 hour")
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    rows = {str(r.start): r.n for r in spark.read.parquet(out).collect()}
    assert rows["2024-01-01 00:00:00"] == 1 and rows["2024-01-01 05:00:00"] == 1


def test_gate_order(spark):
    requests = spark.sql("SELECT request, action, 'u' AS user, CASE WHEN request = 2 THEN map('n', '\"x\"') WHEN request = 3 THEN map('n', '1') ELSE cast(map() AS map<string,string>) END AS params FROM VALUES (0, 'none'), (1, 'a'), (2, 'a'), (3, 'a'), (4, 'open') AS t(request, action)")
    acts = spark.sql("SELECT * FROM VALUES ('a', true), ('open', false) AS t(action, performers_only)")
    params = spark.sql("SELECT 'a' AS action, 'n' AS name, 'number' AS type, true AS required")
    got = {r.request: r.fault for r in actions.gate(requests, acts, params, spark.sql("SELECT 'b' AS action, 'u' AS user")).collect()}
    assert got == {0: "no-action", 1: "missing-param", 2: "param-type", 3: "not-allowed", 4: None}


def test_vocabulary():
    assert len(vocab.CLASSES) == 15 and len(vocab.PREDICATES) == 51 and len(vocab.DATATYPES) == 19 and len({p for p, *_ in vocab.PREDICATES}) == 51
    assert all(set(d.split()) | set(r.split()) <= set(vocab.CLASSES) for _, d, r, _ in vocab.PREDICATES)


def test_whole_texts_keep_long_lines_and_open_fences(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    content = f"# {long}\n```{long}\n# {long}\n- no list"
    rows = spark.createDataFrame([("u", content)], "uri string, content string")
    got = text.blocks(rows).orderBy("block_index").collect()
    assert [(r.block_type, r.text, r.language) for r in got] == [("heading", long, None), ("code", f"# {long}\n- no list", long)]
    assert one(text.blocks_to_text(text.blocks(rows))).content == content + "\n```"


def test_whole_texts_are_read_whole(spark):
    from quillgraph.jobs import queries_graph
    from quillgraph.jobs.model import Model

    m = Model(spark, "/root/testdata/sf0.001")
    got = {r.uri: r.content for r in queries_graph.whole(m).collect()}
    marks = queries_graph.MARKS
    for r in m.table("documents").select("doc_id", "text").collect():
        assert got[f"bm:symbol:d{r.doc_id}"] == "\n".join(marks[(r.doc_id + i) % len(marks)] + line for i, line in enumerate(r.text.split("\n")))


def test_responses_and_documents_are_bounded(spark):
    from quillgraph.jobs import queries_mapping
    from quillgraph.jobs.model import Model

    m = Model(spark, "/root/testdata/sf0.001")
    bodies = queries_mapping.responses(m, 3).select(F.size(F.from_json("body", "data array<string>, more boolean")["data"]).alias("n")).collect()
    assert max(r.n for r in bodies) <= 3 and sum(r.n for r in bodies) == m.table("events").count()
    own = "cast(row_number() over (partition by user_id order by event_id) - 1 as int)"
    want = m.table("events").selectExpr("user_id", f"{own} as record_index", "event_type")
    got = queries_mapping.records_of(m, "$.data", 3).select("user_id", "record_index", json_text.string_of(paths.value_at(F.col("record"), "type")).alias("event_type"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert queries_mapping.numbered(m.table("events"), 7).selectExpr("user_id", "cast(n as int)", "event_type").exceptAll(want).isEmpty()
    customers = m.table("customer")
    assert queries_mapping.bucketed(customers, 10).groupBy("c_nationkey", "bucket").count().where("count > 10").isEmpty()
    people = lambda rows: files.flatten_models(rows)[1]
    documents = queries_mapping.model_documents(m, 10)
    assert documents.count() > 25 and people(documents).count() == customers.count()


def test_csv_files_have_a_header_each(spark):
    path = files.scratch(spark, "csv")
    files.write_csv_lines(spark.range(0, 100, 1, 4).selectExpr("concat(id, ',x') AS value"), path, "id,name")
    heads = spark.read.text(path, wholetext=True).selectExpr("split(value, '\n')[0] AS head").collect()
    assert [r["head"] for r in heads] == ["id,name"] * 4
    assert {int(r.id) for r in files.read_csv(spark, path, ["id", "name"]).collect()} == set(range(100))


def test_closure_has_no_bound(spark):
    chain = spark.range(70).selectExpr("concat('n', id) AS node", "concat('n', id + 1) AS up")
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, up string")
    got = {(r.node, r.ancestor): r.depth for r in graph.closure(chain.union(ring)).collect()}
    want = {(f"n{a}", f"n{b}"): b - a for a in range(70) for b in range(a + 1, 71)}
    assert got == want | {("a", "b"): 1, ("b", "a"): 1, ("a", "a"): 2, ("b", "b"): 2}


def test_csv_cells_go_by_their_own_header(spark, tmp_path):
    """Headers in any order, one per file; a file in several parts; a column that a file lacks; a name that occurs twice."""
    (tmp_path / "a.csv").write_text("size, id ,name\n5,1,foo\r\n\n6,2\n")
    (tmp_path / "b.csv").write_text("id,name\n" + "".join(f"{k},n{k}\n" for k in range(10, 4000)))
    (tmp_path / "c.csv").write_text("name,id,name\nfirst,3,second\nname,id,name\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = {r["id"]: (r["name"], r["size"]) for r in files.read_csv(spark, str(tmp_path), ["id", "name", "size"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["1"] == ("foo", "5") and got["2"] == ("", "6") and got["3"] == ("second", None) and got["id"] == ("name", None)
    assert len(got) == 4 + 3990 and all(got[str(k)] == (f"n{k}", None) for k in range(10, 4000))


def test_closure_and_cycles_take_few_rounds(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "node int, up int")
    assert sorted((r.node, r.ancestor, r.depth) for r in graph.closure(chain).collect()) == [(a, b, b - a) for a in range(200) for b in range(a + 1, 201)]
    # with a shorter way and a cycle
    edges = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (4, 2)]
    known = {a: {b: 1 for x, b in edges if x == a} for a in range(5)}
    for _ in range(5):
        for a in known:
            for b, d in list(known[a].items()):
                for c, e in list(known[b].items()):
                    known[a][c] = min(known[a].get(c, 99), d + e)
    got = {(r.node, r.ancestor): r.depth for r in graph.closure(spark.createDataFrame(edges, "node int, up int")).collect()}
    assert got == {(a, b): d for a in known for b, d in known[a].items()}
    rows = [("a", "b", 1), ("b", "a", 1), ("b", "c", 2), ("c", "d", 1), ("x", "y", 1), ("y", "z", 1), ("z", "y", 2), ("z", "w", 1)] + [(f"t{k}", f"t{k + 1}", 1) for k in range(40)] + [("t40", "x", 1)]
    got = graph.circular_extends(spark.createDataFrame(rows, "src string, dst string, ord int"), "ord")
    assert sorted(r.id for r in got.collect()) == ["y", "z"]


def test_removing_the_top_of_a_deep_chain(spark):
    contexts = spark.createDataFrame([(f"c{k}", f"c{k - 1}" if k else None) for k in range(200)], "uri string, parent_uri string")
    below = graph.context_tree(contexts).where("ancestor = 'c0'")
    assert below.count() == 200 and below.agg(F.max("depth")).first()[0] == 199


def test_plans_of_queries(spark):
    """Steps add scans, they don't multiply them; a predicate prunes the links' tables."""
    from quillgraph.jobs.model import Model
    from quillgraph.jobs.queries import QUERIES

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sf = "/root/testdata/sf0.001"
    flagship = plan(QUERIES["flagship"](spark, sf))
    assert flagship.count("FileScan") < 15 and "documents" not in flagship and "lineitem" not in flagship
    builder = plan(QUERIES["query_builder"](spark, sf))
    assert builder.count("FileScan") < 15 and "lineitem" not in builder
    performs = plan(Model(spark, sf).links.where("predicate = 'performs'"))
    assert performs.count("FileScan") == 1 and "lineitem" not in performs


def test_compacted_log_gives_the_same_state(spark):
    import random

    from quillgraph.operators import log

    draw = random.Random(9)
    rows = []
    for n in range(400):
        kind = draw.choice(["upsert", "update", "update", "update", "delete"])
        data = {draw.choice("abc"): str(n) for _ in range(draw.randint(0, 2))} if kind != "delete" else {}
        rows.append((n, f"instance:{kind}", "t", draw.choice(["Thing", "Thing", "Measure"]), f"u{draw.randint(0, 9)}", data, n * 10))
    schema = "sequence int, cmd_type string, type_uri string, class_id string, uri string, data map<string,string>, ts int"
    state = lambda df: sorted((r.uri, sorted(r.data.items()), r.created_at, r.updated_at) for r in log.replay(df).collect())
    kept = None
    for at in range(0, 400, 80):
        part = spark.createDataFrame(rows[at : at + 80], schema)
        kept = spark.createDataFrame(log.compact(part if kept is None else kept.unionByName(part)).collect(), schema)
        assert state(kept) == state(spark.createDataFrame(rows[: at + 80], schema))
        assert kept.count() <= 10 * 3


def test_walks_and_ends_of_the_model(spark):
    """Ends are those of the links, once per predicate and direction, and no plan groups pairs; a walk's edges may repeat."""
    from quillgraph.jobs.model import Model
    from quillgraph.operators.joins import link_counts

    m = Model(spark, "/root/testdata/sf0.001")
    key = ["map_id", "id", "predicate", "direction"]
    found = [tuple(r) for r in m.linked().select(*key).collect()]
    assert len(found) == len(set(found)) and set(found) == {tuple(r) for r in link_counts(m.links).select(*key).collect()}
    assert {tuple(r) for r in m.walks().select("uri").collect()} == {tuple(r) for r in m.links.select("uri").collect()}
    assert "Aggregate" not in m.walks("stewards", "performs", "reads")._jdf.queryExecution().optimizedPlan().toString()
    only = m.linked({("reads", "outgoing")})
    assert {(r.predicate, r.direction) for r in only.collect()} == {("reads", "outgoing")} and only._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "c"), ("x", "c"), ("c", "d"), ("d", "e")], [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], [("a", "b"), ("a", "c"), ("c", "d")], [("a", "a")]])
def test_closure_of_chains(spark, monkeypatch, edges):
    rows = spark.createDataFrame(edges, "node string, up string")
    want = sorted(map(tuple, graph.closure(rows).select("node", "ancestor", "depth").collect()))
    assert sorted(map(tuple, graph.chain_closure(rows).select("node", "ancestor", "depth").collect())) == want
    if len(edges) == 5:  # chains alone need no grouping of pairs
        monkeypatch.setattr(graph, "closure", None)
        assert sorted(map(tuple, graph.chain_closure(rows).select("node", "ancestor", "depth").collect())) == want
