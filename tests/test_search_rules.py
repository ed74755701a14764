"""Search by an index, rules as a table, long lists, mentions of any number."""

from __future__ import annotations

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import quality, search, sets
from quillgraph.sources.files import scratch

ENTITIES = "map_id string, uri string, class_id string, container_uri string, name string, is_custom boolean, fields map<string,string>"


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 5)))
    rows = [("m", f"t{k}", "Thing", f"c{k % 3}", word(), False, {"definition": f'"{word()} {word()}"', "attributes": f'[{{"name":"{word()}"}},{{"name":"{word().upper()}"}}]', "rules": f'["{word()} {word()}"]'}) for k in range(120)]
    rows += [("m", "x1", "Thing", None, None, False, {}), ("m", "x2", "Thing", "c0", "custom abc", True, {}), ("n", "t1", "Action", "c1", "Abcde", False, {"role": '"r"', "definition": "null"})]
    notes = [("m", f"s{k}", "Symbol", "c1", None, False, {"content": f'"{" ".join(word() for _ in range(30))}"'}) for k in range(20)] + [("m", "s99", "Symbol", "c1", None, False, {"content": '"' + "é" * 30_000 + ' end"', "label": '"Long"'})]
    contexts = [("m", f"c{k}", "c0" if k else None, word(), {"description": f'"{word()}"'} if k == 1 else {}) for k in range(3)]
    return SimpleNamespace(entities=spark.createDataFrame(rows, ENTITIES), symbols=spark.createDataFrame(notes, ENTITIES), contexts=spark.createDataFrame(contexts, "map_id string, uri string, parent_uri string, name string, fields map<string,string>"))


def test_the_index_finds_what_the_scan_finds(spark, model):
    path = scratch(spark, "index")
    search.write_index(sets.searchable(model), path, 16)
    plain = lambda df: sorted(map(str, df.collect()))
    hits = 0
    for q in ("abc", "ABCD", "a", "", "é", "dé ab", "end", "long é", "no such", "custom", "ca b", "éééé", "b c"):
        scanned = plain(sets.search(model, q))
        assert plain(search.search(spark, path, q, model.contexts)) == scanned, q
        hits += len(scanned)
    assert hits > 100
    assert plain(search.search(spark, path, "abc", model.contexts, ["Action"])) == plain(sets.search(model, "abc", ["Action"])) != []


def test_a_search_reads_its_own_buckets(spark, model):
    path = scratch(spark, "index")
    search.write_index(sets.searchable(model), path, 16)
    found = search.candidates(spark, path, "abc")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert all("/postings/" in f for f in found.inputFiles())
    assert spark.read.parquet(f"{path}/postings").select("bucket").distinct().count() > 1


def test_nothing_to_search(spark, model):
    path = scratch(spark, "index")
    search.write_index(sets.searchable(model).limit(0), path, 2)
    assert search.search(spark, path, "abc", model.contexts).count() == 0


def instances(spark, n, things):
    rows = [(f"t{k % things}", f"i{k}", {"a": ("text", f'"{k}"'), "n": ("integer", str(k)), "e": ("text", '"x"' if k % 2 else "null")} | ({} if k % 3 else {"z": ("text", '"?"')})) for k in range(n)]
    return spark.createDataFrame(rows, "thing_id string, id string, attributes map<string,struct<type: string, value: string>>")


def test_rules_of_thousands_of_things(spark):
    declared = {f"t{k}": {"a": {"type": "text", "required": True, "regex": f"^{k}$"}, "n": {"type": "integer", "high": 2.0 * k}, "e": {"type": "text", "required": True, "enum": ["x"]}, "m": {"type": "email", "value_type": "email"}} for k in range(5000)}
    rules = quality.rules_table(spark, declared)
    rows = instances(spark, 6000, 6000)
    began = time.perf_counter()
    found = quality.validate_instances(rows, rules)
    size = len(found._jdf.queryExecution().optimizedPlan().toString())
    got = sorted((r.id, r.attribute or "", r.fault) for r in found.collect())
    assert time.perf_counter() - began < 20
    assert size == len(quality.validate_instances(rows, rules.where("thing_id = 't1'").unionByName(rules.limit(0)).limit(10**9))._jdf.queryExecution().optimizedPlan().toString()) or size < 20_000
    wanted = []
    for k in range(6000):
        if k >= 5000:
            wanted.append((f"i{k}", "", "thing"))
            continue
        wanted += [(f"i{k}", "e", "required")] if k % 2 == 0 else []
        wanted += [] if k % 3 else [(f"i{k}", "z", "unknown")]
    assert got == sorted(wanted)


def test_rules_one_by_one(spark):
    rules = quality.rules_table(spark, {"t0": {"a": {"type": "integer"}, "n": {"type": "integer", "low": 3}, "e": {"type": "text", "enum": ["y"]}}})
    got = {(r.id, r.attribute, r.fault) for r in quality.validate_instances(instances(spark, 3, 1), rules).collect()}
    assert got == {("i0", "a", "type"), ("i1", "a", "type"), ("i2", "a", "type"), ("i0", "n", "range"), ("i1", "n", "range"), ("i2", "n", "range"), ("i1", "e", "enum"), ("i0", "z", "unknown")}
    forms = instances(spark, 3, 1).withColumn("interface_id", F.when(F.col("id") == "i1", "no").otherwise("f")).drop("thing_id")
    got = {(r.id, r.attribute, r.fault) for r in quality.validate_forms(forms, {"f": "t0"}, rules).collect()}
    assert ("i1", None, "interface") in got and ("i2", "a", "type") in got and not any(i == "i1" and f != "interface" for i, _, f in got)


def test_one_of_many_values(spark):
    rows = spark.createDataFrame([(1, {"x": "3"}), (2, {"x": '"3"'}), (3, {"x": "true"}), (4, {"x": "null"}), (5, {}), (6, {"x": "4999.0"}), (7, {"x": '"w4999"'})], "id int, fields map<string,string>")
    began = time.perf_counter()
    values = [*range(5000), *[f"w{k}" for k in range(5000)], None, True]
    assert {r.id for r in rows.where(sets.one_of("x", values)).collect()} == {1, 3, 4, 6, 7}
    assert {r.id for r in rows.where(~sets.one_of("x", values)).collect()} == {2, 5}
    assert time.perf_counter() - began < 20
    assert rows.where(sets.one_of("x", [])).count() == 0


def test_selectors(spark):
    rows = spark.createDataFrame([("a", ["x"]), ("b", ["y", "z"]), ("c", None), ("d", [])], "uri string, tags array<string>")
    of = lambda *a: {r.uri for r in quality.selected(rows, *a).collect()}
    assert of("tagged", ["x", "z"]) == {"a", "b"} and of("tagged", "y") == {"b"} and of("tagged") == of("tagged", []) == {"a", "b", "c", "d"}


def test_very_many_mentions(spark):
    n = 100_000
    content = "".join(f"@[T:l{k}:{k}] @[Old](thing:{k}) " for k in range(n // 2)) + "@[A:@[B:b:1]](x:2)"
    rows = spark.createDataFrame([("u", content), ("v", None), ("w", "no @[one")], "uri string, content string")
    text.mentions(rows.where("uri = 'w'")).count()  # starts workers
    began = time.perf_counter()
    got = text.mentions(rows).select("start", "kind", "label", "id").collect()
    assert time.perf_counter() - began < 8
    assert len(got) == n + 1 and got[0] == (1, "T", "l0", "0") and got[-1].id == "1"
    assert [r.start for r in got] == sorted(r.start for r in got)
