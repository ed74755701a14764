"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The model's tables in DuckDB, as CTEs that a query names when it needs them.
CTES = {
    "C": """C AS (SELECT 'bm:ctx:root' AS uri, NULL AS parent_uri, 'root' AS name, NULL AS tag
      UNION ALL SELECT 'bm:ctx:r' || r_regionkey, 'bm:ctx:root', r_name, 'region' FROM region
      UNION ALL SELECT 'bm:ctx:n' || n_nationkey, 'bm:ctx:r' || n_regionkey, n_name, 'nation' FROM nation)""",
    "E": """E AS (SELECT 'bm:persona:c' || c_custkey AS uri, 'Persona' AS class_id, 'bm:ctx:n' || c_nationkey AS container_uri, c_name AS name, c_mktsegment AS tag FROM customer
      UNION ALL SELECT 'bm:persona:s' || s_suppkey, 'Persona', 'bm:ctx:n' || s_nationkey, s_name, NULL FROM supplier
      UNION ALL SELECT 'bm:thing:p' || p_partkey, 'Thing', 'bm:ctx:root', p_name, p_brand FROM part
      UNION ALL SELECT 'bm:action:o' || o_orderkey, 'Action', 'bm:ctx:root', 'Order ' || o_orderkey, o_orderpriority FROM orders)""",
    "N": """N AS (SELECT uri, name, class_id, container_uri FROM E UNION ALL SELECT uri, name, 'Context', parent_uri FROM C)""",
    "X": """X AS (SELECT 'bm:thing:p' || p_partkey AS source_uri, 'bm:thing:p' || CASE WHEN p_partkey % 100 = 98 THEN p_partkey + 1 WHEN p_partkey % 100 = 99 THEN p_partkey - 1 ELSE p_partkey // 10 END AS target_uri
      FROM part WHERE p_partkey >= 10)""",
    "V": """V AS (SELECT DISTINCT 'bm:ctx:n' || n_nationkey AS source_uri, 'bm:ctx:n' || t AS target_uri
      FROM (SELECT n_nationkey, unnest([(2 * n_nationkey + 1) % 25, (3 * n_nationkey + 2) % 25]) AS t FROM nation) WHERE n_nationkey <> t)""",
    "L": """L AS (SELECT 'performs' AS predicate, 'bm:persona:c' || o_custkey AS source_uri, 'bm:action:o' || o_orderkey AS target_uri FROM orders
      UNION ALL SELECT DISTINCT CASE WHEN l_returnflag = 'N' THEN 'reads' ELSE 'writes' END, 'bm:action:o' || l_orderkey, 'bm:thing:p' || l_partkey FROM lineitem
      UNION ALL SELECT DISTINCT 'stewards', 'bm:persona:s' || l_suppkey, 'bm:thing:p' || l_partkey FROM lineitem
      UNION ALL SELECT 'valueStream', source_uri, target_uri FROM V UNION ALL SELECT 'extends', source_uri, target_uri FROM X)""",
    "CMD": """CMD AS (SELECT event_id AS sequence, ts, user_id, event_type, value,
        CASE WHEN event_type IN ('signup', 'purchase') THEN 'upsert' WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS kind,
        CASE user_id % 10 WHEN 7 THEN 'Measure' WHEN 8 THEN 'Port' WHEN 9 THEN NULL ELSE 'Thing' END AS class_id FROM events)""",
}
ORDER = ("C", "E", "N", "X", "V", "L", "CMD")
NEEDS = {"N": ("C", "E"), "L": ("X", "V")}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    wanted = set(names.split())
    for name in list(wanted):
        wanted |= set(NEEDS.get(name, ()))
    parts = ", ".join(CTES[name] for name in ORDER if name in wanted)
    body = body.strip()
    glue = ", " if parts and body[:5].upper() == "WITH " else " "
    rest = body[5:] if glue == ", " else body
    if not parts:
        return f"WITH RECURSIVE {body[5:]}" if recursive else body
    return ("WITH RECURSIVE " if recursive else "WITH ") + parts + glue + rest


def query(sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Registers a function (spark, sf_dir) under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_ctes(ctes, sql, recursive)
        return f

    return add
