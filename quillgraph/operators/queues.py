"""First-in-first-out queues in bulk: which element each of very many takers gets, by ranks in place of a fold.

The k-th taker that finds something takes the k-th element, so both sides are ranked and joined by rank. How many takers found
nothing before follows from a running maximum: takers so far less elements so far, where that is more than ever before.
Ranks come from segmented scans, so one queue that all operations share is spread over ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.scan import RANGE, before, in_ranges

#: Parts that askers of one element are dealt to.
PARTS = 64


def ranked(held: DataFrame, keys: list[str], order: str, rows: int = RANGE) -> DataFrame:
    """held with _rank, from 1 on, by `order` within the keys."""
    placed = before(in_ranges(held, order, rows), keys, order, {}, {"_rank": F.lit(1)})
    return placed.withColumn("_rank", F.col("_rank") + 1).drop("_range")


def fifo(operations: DataFrame, held: DataFrame, keys: list[str], order: str, rows: int = RANGE) -> DataFrame:
    """operations (keys, order, kind: push, pop or peek; id: what a push adds) with `taken`: the element that a pop takes or a
    peek sees, NULL where the queue is empty. held: keys, id; what a queue holds at first, by id."""
    push, pop = F.when(F.col("kind") == "push", 1), F.when(F.col("kind") == "pop", 1)
    first = ranked(held.select(*keys, "id"), keys, "id", rows)
    sizes = first.groupBy(*keys).agg(F.max("_rank").alias("_held")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_held")
    counted = before(in_ranges(operations, order, rows), keys, order, {}, {"_pushed": push, "_asked": pop})
    counted = counted.join(sizes, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").withColumn("_held", F.coalesce("_held", F.lit(0))).drop(*[f"_k_{k}" for k in keys])
    # Takers in vain: as often as takers so far outran elements so far by more than before.
    lead = F.when(pop.isNotNull(), F.col("_asked") + 1 - F.col("_held") - F.col("_pushed"))
    known = before(counted, keys, order, {}, None, {"_vain": lead})
    done = F.col("_asked") - F.greatest(F.coalesce("_vain", F.lit(0)), F.lit(0))
    there = F.col("_held") + F.col("_pushed")
    known = known.withColumn("_rank", F.when((F.col("kind") != "push") & (done < there), done + 1).when(F.col("kind") == "push", there + 1))
    known = known.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(PARTS)))

    elements = first.select(*keys, "_rank", "id").unionByName(known.where("kind = 'push'").select(*keys, "_rank", "id"))
    elements = elements.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_rank").alias("_k__rank"), F.col("id").alias("taken"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_rank") == F.col("_k__rank")]
    # Very many may see the same element: each part of them asks once.
    asked = known.where("kind != 'push' and _rank is not null").select(*keys, "_rank", "_part").distinct()
    answers = asked.join(elements, same).select(*[F.col(f"_k_{k}") for k in keys], "_k__rank", F.col("_part").alias("_k__part"), "taken")
    met = known.join(answers, [*same, F.col("_part") == F.col("_k__part"), F.col("kind") != "push"], "left")
    return met.select(*operations.columns, "taken")
