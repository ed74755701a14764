"""Turtle and JSON-LD from a sort: the same text as from a list per subject, with a hub over many ranges."""

from __future__ import annotations

import json
import os
import random

import pytest

from quillgraph.operators import triples
from quillgraph.sources.files import scratch


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(6)
    out = [("hub", "hasPart", f"part {k}") for k in range(300)] + [("hub", "rdf:type", "bm:Thing"), ("hub", "rdfs:label", 'say "x"')]
    for k in range(60):
        s = f"s{k:02d}"
        out += [(s, p, f"o{draw.randrange(4)}") for p in draw.sample(["a:b", "memberOf", "hasTag"], draw.randint(0, 3)) for _ in range(draw.randint(1, 3))]
        out += [(s, "rdf:type", t) for t in draw.sample(["bm:Thing", "bm:Action"], draw.randint(0, 2))]
    return spark.createDataFrame(sorted(set(out), key=lambda _: draw.random()), "s string, p string, o string")


def document(path):
    parts = sorted((d for d in os.listdir(path) if d.startswith("_range=")), key=lambda d: int(d.partition("=")[2]))
    text = ""
    for d in parts:
        names = [f for f in os.listdir(f"{path}/{d}") if f.endswith(".txt")]
        assert len(names) == 1
        text += open(f"{path}/{d}/{names[0]}").read()
    return parts, text


@pytest.mark.parametrize("size", [25, 1_000_000])
def test_turtle(spark, rows, size):
    path = scratch(spark, "ttl")
    triples.write_lines(triples.turtle_lines(rows, size), path)
    parts, text = document(path)
    assert len(parts) > 5 if size == 25 else len(parts) == 1
    blocks = {r.s: r.value for r in triples.turtle(rows).collect()}
    assert text == "".join(blocks[s] + "\n" for s in sorted(blocks))


@pytest.mark.parametrize("size", [25, 1_000_000])
def test_jsonld(spark, rows, size):
    path = scratch(spark, "jsonld")
    triples.write_lines(triples.jsonld_lines(rows, size), path)
    _, text = document(path)
    joined = text.replace("\n", "")
    nodes = {r.s: r.value for r in triples.jsonld(rows).collect()}
    plain = [json.loads(nodes[s].replace('say "x"', r"say \"x\"") if s == "hub" else nodes[s]) for s in sorted(nodes)]
    assert json.loads("[" + joined.replace("}{", "},{") + "]") == plain


def test_a_range_holds_few_rows_of_a_hub(spark, rows):
    found = triples.in_order(rows, 25)
    counts = [r["count"] for r in found.groupBy("_range").count().collect()]
    assert max(counts) < 100 and sum(counts) == rows.count()
    assert sorted(r._n for r in found.collect()) == list(range(1, rows.count() + 1))


def test_no_triples(spark, rows):
    assert triples.turtle_lines(rows.limit(0)).count() == triples.jsonld_lines(rows.limit(0)).count() == 0
