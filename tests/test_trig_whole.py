"""The instances' graph of a dataset holds the relationships too."""

from __future__ import annotations

import duckdb

from quillgraph.jobs import queries_mapping
from quillgraph.jobs.queries import ORACLES, QUERIES
from tests.compare import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def test_relationships_are_in_the_graph(spark, tmp_path, monkeypatch):
    """A line for every order, beside eight for every customer."""
    count = lambda name: duckdb.connect().execute(f"SELECT count(*) FROM '{SF}/{name}.parquet'").fetchone()[0]
    monkeypatch.setattr(queries_mapping.files, "scratch", lambda _, name: str(tmp_path / name))
    df = QUERIES["sink_trig"](spark, SF)
    assert rows_of(df) == rows_of_sql(SF, ORACLES["sink_trig"])
    assert {r.graph: r.n for r in df.collect()}["instances"] == 8 * count("customer") + count("orders")
    lines = [r.value for r in spark.read.text(str(tmp_path / "trig" / "graph=instances")).collect() if "/vocab/placed>" in r.value]
    assert len(lines) == len(set(lines)) == count("orders")
    assert all("entity/bm%3Ainst%3A" in x and x.endswith('" .') and '"bm:order:' in x for x in lines)
