"""Links counted by their tables' keys: what moves, and what counts."""

from __future__ import annotations

import re
from collections import Counter

import duckdb

from quillgraph.jobs.model import Model
from quillgraph.jobs.queries import ORACLES, QUERIES
from quillgraph.operators.joins import link_summary
from tests.compare import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_keys_move(spark):
    """No exchange is by ids or names, and none carries the name at the other end."""
    df = QUERIES["entity_link_summary"](spark, SF)
    moved = re.findall(r"Exchange hashpartitioning\(([^()]*)\)", plan(df))
    assert moved and {key.split("#")[0].strip() for by in moved for key in by.split(",") if "#" in key} <= {"source", "target", "n_nationkey", "to"}
    assert rows_of(df) == rows_of_sql(SF, ORACLES["entity_link_summary"])


def test_both_ends_read_one_shuffle_of_pairs(spark):
    """No test for null on one end parts the plans of the two."""
    lines = [x for x in plan(QUERIES["entity_link_summary"](spark, SF)).splitlines() if "FileScan" in x and "l_orderkey" in x]
    assert lines and not any("IsNotNull(l_orderkey)" in x or "IsNotNull(l_partkey)" in x for x in lines)


def test_links_of_missing_and_unknown_ends(spark, tmp_path):
    """A pair counts once, a link to what isn't there counts at its other end, an end that isn't there has no row."""
    con = duckdb.connect()
    put = lambda name, sql: con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT PARQUET)")
    for name in ("region", "nation", "supplier", "documents"):
        put(name, f"SELECT * FROM '{SF}/{name}.parquet'")
    put("customer", f"SELECT * FROM '{SF}/customer.parquet' WHERE c_custkey <= 2")
    put("part", f"SELECT * FROM '{SF}/part.parquet' WHERE p_partkey IN (1, 2, 10, 30)")  # 30 extends 3, which isn't there
    put("orders", f"SELECT * REPLACE (CASE o_orderkey WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 99999 END::BIGINT AS o_custkey) FROM '{SF}/orders.parquet' WHERE o_orderkey BETWEEN 1 AND 4")
    rows = [(1, 1, 1, "N"), (1, 1, 1, "N"), (1, 2, 1, "A"), (2, 1, None, "N"), (7, 1, 1, "N"), (2, None, 1, "N"), (3, 9999, 2, None)]
    values = ", ".join("({})".format(", ".join("NULL" if v is None else repr(v) for v in row)) for row in rows)
    put("lineitem", f"SELECT t.* REPLACE (v.o::BIGINT AS l_orderkey, v.p::BIGINT AS l_partkey, v.s::BIGINT AS l_suppkey, v.f AS l_returnflag) FROM (VALUES {values}) v(o, p, s, f), (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1) t")
    found = {(r.id, r.predicate, r.direction): r.n for r in link_summary(Model(spark, str(tmp_path))).where("predicate != 'valueStream'").collect()}
    out = Counter({("bm:persona:c1", "performs"): 2, ("bm:action:o1", "reads"): 1, ("bm:action:o1", "writes"): 1, ("bm:action:o2", "reads"): 2, ("bm:action:o3", "writes"): 1, ("bm:persona:s1", "stewards"): 3, ("bm:persona:s2", "stewards"): 1, ("bm:thing:p10", "extends"): 1, ("bm:thing:p30", "extends"): 1})
    into = Counter({**{(f"bm:action:o{k}", "performs"): 1 for k in (1, 2, 3, 4)}, ("bm:thing:p1", "reads"): 3, ("bm:thing:p2", "writes"): 1, ("bm:thing:p1", "stewards"): 2, ("bm:thing:p2", "stewards"): 1, ("bm:thing:p1", "extends"): 1})
    assert found == {**{(*k, "outgoing"): n for k, n in out.items()}, **{(*k, "incoming"): n for k, n in into.items()}}
