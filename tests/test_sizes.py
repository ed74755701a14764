"""What a query holds in a task or makes of a plan, where that once grew faster than its tables."""

from __future__ import annotations

import pyarrow as pa
import pytest

from quillgraph.functions import text as texts
from quillgraph.jobs import queries_mapping
from quillgraph.jobs.model import Model
from quillgraph.jobs.queries import ORACLES, QUERIES
from quillgraph.operators import search, triples
from tests.compare import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["attachment_lifts", "sink_trig", "prune_dangling_links", "whole_mentions", "document_changes", "document_merge", "search_index"])
def test_same_rows(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(SF, ORACLES[name])


def test_lifted_attachments_are_made_once(spark):
    """The links' plan reads the lifted facets, it doesn't repeat what lifts them (ids are sha2 of the owner)."""
    assert "sha2(" not in plan(QUERIES["attachment_lifts"](spark, SF))


def test_graphs_are_written_apart(spark, tmp_path):
    """A folder a graph, from lines that carry no graph to be sorted by."""
    one = lambda s, o: spark.createDataFrame([(s, "rdf:type", o)], "s string, p string, o string")
    graphs = triples.trig(one("tag:a", "bm:Tag"), one("bm:a", "bm:Thing"), one("bm:i", "x").where("s is null"))
    assert all(lines.columns == ["value"] for lines in graphs.values())
    triples.write_trig(graphs, str(tmp_path / "trig"))
    found = spark.read.text(str(tmp_path / "trig")).collect()
    assert sorted(r.graph for r in found) == ["model", "vocabulary"] and all("#type> <" in r.value for r in found)


def test_links_are_pruned_before_pairs_are_grouped(spark):
    """Lines aren't moved to be grouped by pairs and moved again to meet their ends."""
    assert "Aggregate [l_" not in plan(QUERIES["prune_dangling_links"](spark, SF))


def test_mentions_leave_in_parts(monkeypatch):
    """A text's mentions leave Python by MENTIONS rows, whatever its length; none is lost at a part's end."""
    monkeypatch.setattr(texts, "MENTIONS", 3)
    monkeypatch.setattr(texts, "CHARACTERS", 20)
    said = ["@[T:a:1] and @[Old](x:2) " * 4, "none @[", "@[T:b:3:c]", "@[N:M](e:4)@[T:d:5]"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(said)], names=["uri", "content"])
    parts = list(texts._all_mentions(iter([batch])))
    assert max(p.num_rows for p in parts) <= 3
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    first = [(1, 25 * k + start, token, kind, label, id_, None) for k in range(4) for start, token, kind, label, id_ in ((1, "@[T:a:1]", "T", "a", "1"), (14, "@[Old](x:2)", "x", "Old", "2"))]
    assert rows == [*first, (3, 1, "@[T:b:3:c]", "T", "b", "3", "c"), (4, 1, "@[N:M](e:4)", "e", "N:M", "4", None), (4, 12, "@[T:d:5]", "T", "d", "5", None)]


def test_versions_lie_in_parts_by_customers(spark, monkeypatch):
    """150 customers at 40 to a part: every side of a version's join has four parts, however few Spark would take."""
    monkeypatch.setattr(queries_mapping, "CUSTOMERS", 40)
    rows = queries_mapping.versioned(Model(spark, SF), "ours")
    assert rows.rdd.getNumPartitions() == 1 + 150 // 40
    assert rows.groupBy("kind", "uri").count().where("count > 1").isEmpty()


def test_trigrams_are_numbers(monkeypatch):
    """A trigram of any code points is one long, once a row, and leaves Python in parts."""
    monkeypatch.setattr(search, "GATHERED", 2)
    said = ["abab", "ab", None, "\U0001f600é\U0010ffff", "aaaa"]
    batch = pa.RecordBatch.from_arrays([pa.array([10, 11, 12, 13, 14]), pa.array([0] * 5, pa.int32()), pa.array(said)], names=["row", "row_bucket", "searched"])
    parts = list(search._posted(iter([batch])))
    whole = lambda g: "".join(chr(g >> by & (1 << 21) - 1) for by in (42, 21, 0))
    assert [(r["row"], whole(r["gram"])) for p in parts for r in p.to_pylist()] == [(10, "aba"), (10, "bab"), (13, "\U0001f600é\U0010ffff"), (14, "aaa")]
    assert len(parts) == 2
