"""Last values and sums before each row of a key, in order, without a window over a key's whole log.

A log is cut into ranges of its order. Within a range, a key's rows see each other in a window; a range gives per key one row,
its transition (the last values set and the sums); transitions are composed over the ranges of a key; what a range starts
with is joined back to its rows. A key that holds all rows is a window per range and a row per range, never one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.sources.files import durable

#: Rows of a range.
RANGE = 1_000_000


def in_ranges(log: DataFrame, order: str, rows: int = RANGE) -> DataFrame:
    """log with _range, the number of the range of `order` that a row lies in, written to the shared folder."""
    ranges = max(1, -(-log.count() // rows))
    return durable(log.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()), "ranges")


def before(rows: DataFrame, keys: list[str], order: str, last: dict[str, Column], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """rows (with _range) and for each name in `last` the newest of its values before the row, for each in `sums` their sum
    before the row, for each in `tops` the largest one before; NULL values count as not set. Keys may be NULL."""
    sums, tops = sums or {}, tops or {}
    valued = rows.withColumns({f"_v_{n}": c for n, c in (last | sums | tops).items()})
    value = lambda n: F.col(f"_v_{n}")

    back = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = {f"_w_{n}": F.last(value(n), ignorenulls=True).over(back) for n in last} | {f"_w_{n}": F.coalesce(F.sum(value(n)).over(back), F.lit(0)) for n in sums}
    within |= {f"_w_{n}": F.max(value(n)).over(back) for n in tops}

    made = [F.max_by(value(n), F.when(value(n).isNotNull(), F.col(order))).alias(f"_t_{n}") for n in last] + [F.coalesce(F.sum(value(n)), F.lit(0)).alias(f"_t_{n}") for n in sums]
    made += [F.max(value(n)).alias(f"_t_{n}") for n in tops]
    transitions = valued.groupBy(*keys, "_range").agg(*made)
    over = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"_t_{n}", ignorenulls=True).over(over).alias(f"_c_{n}") for n in last] + [F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_c_{n}") for n in sums]
    carried += [F.max(f"_t_{n}").over(over).alias(f"_c_{n}") for n in tops]
    starts = transitions.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_range"]], *carried)

    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_range") == F.col("_k__range")]
    met = valued.withColumns(within).join(starts, same)
    found = [F.coalesce(f"_w_{n}", f"_c_{n}").alias(n) for n in last] + [(F.col(f"_w_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums]
    found += [F.greatest(f"_w_{n}", f"_c_{n}").alias(n) for n in tops]
    return met.select(*rows.columns, *found)
