"""Mixing sources to target weights, by blocks.

1. The words of a source's documents, one after another, are a stream that is cut into blocks: of `block` words, or of a
   PARTS-th of the source where that is less, so that small sources come near their targets too.
2. Targets: sources in code-point order (null last) have the weights 5, 2, 1, repeating. They share the sum of all sizes
   by weight; a target stops at `most` times its source's size and the excess is shared again by weight: a target is
   min(most * size, level * weight), and the level is raised by sums over the sources until it fits.
3. A target becomes a number of block slots. The slots of the output are dealt to `shards` output shards: every shard
   draws its counts by group of sources (GROUPS groups by hash) from a multinomial over what the groups still have to give,
   and the last takes what is left; then each group's counts are drawn from its sources alike. So the draws of all shards
   add up to the targets.
4. Slot j of a source holds block p(j mod n) of its n blocks, where p is a pseudorandom permutation (a Feistel network with
   cycle walking, another one for each round through the blocks): every block is taken as often as any other, or once more.
5. Slots and blocks are joined by (source, block).

Sources may be any number: their table, ranks, targets, slots and draws are Spark's; the driver holds the sums of GROUPS groups.

Defined results: a null text counts as empty; documents without words are never taken; repeated rows are documents of
their own; a null source is a source; an empty table gives an empty mix; reruns agree (all draws follow from `seed`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import WORD, materialize, meet, running_start, slices

WEIGHTS, MOST, BLOCK, SHARDS, SEED = (5, 2, 1), 3, 128, 64, 20240607
GROUPS, PARTS, PIECE = 1024, 64, 1 << 20
#: Sources whose table is broadcast at most.
MOST_SOURCES = 100_000
_ID, _ROW = "_qg_id", "_qg_row"


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with s, their number in code-point order, null last: numbered within ranges of names, whose
    counts are added up."""
    late = F.col("source").isNull()
    dealt = materialize(sources.repartitionByRange(8, late, "source").withColumn("_part", F.spark_partition_id()), "sources")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # eight rows
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(late, "source"))
    return dealt.join(F.broadcast(before), "_part").withColumn("s", (own + F.col("_before") - 1).cast("long")).drop("_part", "_before")


def level_of(sources: DataFrame, most: float) -> float:
    """The level at which the targets min(most * n, level * weight) add up to all sizes; sources: n > 0, weight."""
    level = 0.0
    while True:
        full = most * F.col("n") < level * F.col("weight")
        row = sources.agg(F.sum("n"), F.sum(F.when(full, F.col("n"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not row[2]:
            return level
        raised = (row[0] - most * (row[1] or 0)) / row[2]
        if raised <= level:
            return level
        level = raised


def deal(slots: np.ndarray, wanted: list[int], seed: int | list[int]) -> np.ndarray:
    """shards x sources: how many slots of each source every shard holds; rows add up to `wanted`, columns to `slots`."""
    draw, left, out = np.random.default_rng(seed), slots.astype(np.int64).copy(), []
    for want in wanted:
        whole = int(left.sum())
        got = np.minimum(draw.multinomial(want, left / whole), left) if want else np.zeros_like(left)
        short = want - int(got.sum())
        for k in np.argsort(got - left, kind="stable") if short else ():  # the sources with most left make up for what was drawn twice
            more = min(short, int(left[k] - got[k]))
            got[k] += more
            short -= more
        left -= got
        out.append(got)
    return np.array(out, np.int64).reshape(len(wanted), len(slots))


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of x under a pseudorandom permutation of range(n)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low, rounds = np.uint64((1 << half) - 1), np.random.default_rng([key & 0xFFFFFFFF, key >> 32, n & 0xFFFFFFFF]).integers(1, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & low
        for r in rounds:
            m = (b + np.uint64(1)) * r
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((m ^ (m >> np.uint64(32))) & low)
        return a << np.uint64(half) | b

    out = once(x.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(documents: DataFrame) -> Column:
    return F.xxhash64("text", *[c for c in documents.columns if c in ("lang", "source", "n_chars")])


class Mix:
    """The mix of a table: its sources with targets, the documents with their places, the slots."""

    def __init__(self, documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> None:
        self.seed = seed
        sized = documents.select(F.col("doc_id").cast("long").alias(_ID), row_key(documents).alias(_ROW), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"))
        self.sized = materialize(sized, "sizes")
        sizes = ranked(self.sized.groupBy("source").agg(F.sum("size").alias("n")))
        weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("s") % len(weights)).cast("int"))
        sizes = materialize(sizes.withColumn("weight", weight), "weights")
        level = level_of(sizes.where("n > 0"), most)
        n, target = F.col("n"), F.least(most * F.col("n").cast("double"), level * F.col("weight"))
        sources = sizes.select("s", F.col("source").alias("name"), n.alias("source_size"), target.alias("target"), F.least(F.lit(block), F.greatest(F.lit(1), (n / PARTS).cast("int"))).cast("int").alias("width"))
        sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.col("width")).cast("long"))
        slots = F.when(F.col("blocks") > 0, F.least(most * F.col("blocks"), F.round(F.try_divide(F.col("blocks") * F.col("target"), F.col("source_size"))).cast("long")))
        sources = sources.withColumn("slots", F.coalesce(slots, F.lit(0)).cast("long")).withColumn("part", F.pmod(F.xxhash64("s"), F.lit(GROUPS)).cast("int"))
        self.sources = materialize(sources, "targets")
        self.many = self.sources.count() > MOST_SOURCES
        groups = self.sources.groupBy("part").agg(F.sum("slots").alias("n")).orderBy("part").collect()  # at most GROUPS rows
        self.total = sum(row["n"] for row in groups)
        dealt = deal(np.array([row["n"] for row in groups], np.int64), even(self.total, shards), seed)
        self.dealt = {row["part"]: dealt[:, k].tolist() for k, row in enumerate(groups)}

    def named(self, rows: DataFrame) -> DataFrame:
        """rows with their source's s, source_size, target and width in place of source."""
        key = lambda name: F.coalesce(F.concat(F.lit("s"), name), F.lit("none"))  # noqa: E731 - null is a source, too
        known = self.sources.select(key(F.col("name")).alias("_key"), "s", "source_size", "target", "width")
        keyed = rows.withColumn("_key", key(F.col("source"))).drop("source")
        return (meet(keyed, known, ["_key"], _ID) if self.many else keyed.join(F.broadcast(known), "_key")).drop("_key")

    def documents(self) -> DataFrame:
        """_qg_id, _qg_row, size, s, source_size, target, width, start (its words' place in the source's stream); written, so
        that the driver doesn't hold their exchanges beside those of what is joined with them."""
        return materialize(running_start(self.named(self.sized.where("size > 0")), "s", "size", [_ID, "size", _ROW], "start"), "starts")

    def slots(self) -> DataFrame:
        """shard, s, j, round, block: every slot of the mix."""
        dealt, seed = self.dealt, self.seed

        def drawn(key: tuple, table: pa.Table) -> pa.Table:
            """The ranges of slots that shards hold of a group's sources."""
            table = table.sort_by("s")
            counts = deal(table["slots"].to_numpy(), dealt[key[0].as_py()], [seed, key[0].as_py()])
            ends = counts.cumsum(axis=0)
            shard, k = np.nonzero(counts)
            columns = {"shard": shard.astype(np.int32), "s": table["s"].to_numpy()[k], "blocks": table["blocks"].to_numpy()[k], "j0": ends[shard, k] - counts[shard, k], "j1": ends[shard, k]}
            return pa.table(columns)

        spans = self.sources.where("slots > 0").groupBy("part").applyInArrow(drawn, "shard int, s bigint, blocks bigint, j0 bigint, j1 bigint")
        pieces = spans.select("shard", "s", "blocks", F.explode(F.expr(f"sequence(j0, j1 - 1, {PIECE}L)")).alias("at"), "j1").withColumn("to", F.least("j1", F.col("at") + PIECE)).drop("j1")
        pieces = pieces.repartition(min(1024, max(8, self.total // PIECE)), "shard", "s", "at")

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, s, n, low, high in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                    j = np.arange(low, high, dtype=np.int64)
                    turn, at = j // n, j % n
                    block = np.empty(len(j), np.int64)
                    for r in np.unique(turn).tolist():
                        block[turn == r] = permuted(at[turn == r], n, seed + (s << 32) + r)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), shard, np.int32)), pa.array(np.full(len(j), s, np.int64)), pa.array(j), pa.array(turn), pa.array(block)], names=["shard", "s", "j", "round", "block"])

        return pieces.mapInArrow(rows, "shard int, s bigint, j bigint, round bigint, block bigint")

    def parts(self) -> DataFrame:
        """One row per document and block that holds words of it: the document's columns, block, low and high (its words there)."""
        cut = self.documents().withColumn("block", F.explode(F.expr("sequence(start div width, (start + size - 1) div width)")))
        low = F.greatest(F.lit(0), F.col("block") * F.col("width") - F.col("start"))
        return cut.withColumn("low", low).withColumn("high", F.least("size", (F.col("block") + 1) * F.col("width") - F.col("start"))).drop("width")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document."""
        times = self.slots().groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
        # Spark takes the slots' size for that of the ranges they are made from; a merge join needs no such guess.
        found = self.parts().join(times.hint("merge"), ["s", "block"], "left")
        words = F.sum((F.col("high") - F.col("low")) * F.coalesce("times", F.lit(0))).cast("long")
        whole = found.groupBy(_ID, "s", "start", "size", "source_size", "target").agg(words.alias("taken")).select(_ID, "size", "source_size", "target", "taken")
        empty = self.named(self.sized.where("size = 0")).select(_ID, "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
        return whole.unionByName(empty).withColumnRenamed(_ID, "doc_id")


def mix_counts(documents: DataFrame, **options) -> DataFrame:
    return Mix(documents, **options).taken()


def mix_texts(documents: DataFrame, **options) -> DataFrame:
    """The mix as rows in the columns of documents: for every round through its source's blocks in which some of a
    document's words are taken, a row with these words (the whole text if all are), white space between them as it was."""
    mix = Mix(documents, **options)
    found = mix.parts().join(mix.slots().select("s", "block", "round").hint("merge"), ["s", "block"])
    pieces = found.groupBy(_ID, _ROW).agg(F.first("size").alias("size"), F.collect_list(F.struct("start", "round", "low", "high")).alias("pieces"))
    pieces = pieces.select(F.col(_ID).alias("_qg_i"), F.col(_ROW).alias("_qg_r"), "size", F.sort_array("pieces").alias("pieces"))
    keyed = documents.withColumns({_ID: F.col("doc_id").cast("long"), _ROW: row_key(documents)})
    columns, at = documents.columns, documents.columns.index("text")
    # Rows equal in both keys are one here: their pieces, told apart by start, have come together above.
    single = keyed.dropDuplicates([_ID, _ROW])
    joined = single.join(pieces, single[_ID].eqNullSafe(pieces["_qg_i"]) & (single[_ROW] == pieces["_qg_r"]))
    joined = joined.select(*[single[c] for c in columns], pieces["size"].alias("_qg_size"), "pieces")
    chars = columns.index("n_chars") if "n_chars" in columns else None
    words = re.compile(WORD)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, texts = [], []
            for k, (text, size, got) in enumerate(zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True)):
                spans, runs = None, {}
                for piece in got:
                    run = runs.setdefault((piece["start"], piece["round"]), [])
                    if run and run[-1][1] == piece["low"]:
                        run[-1][1] = piece["high"]
                    else:
                        run.append([piece["low"], piece["high"]])
                for run in runs.values():
                    if run == [[0, size]]:
                        made = text
                    else:
                        spans = spans or [m.span() for m in words.finditer(text)]
                        made = "\n".join(text[spans[low][0] : spans[high - 1][1]] for low, high in run)
                    own.append(k)
                    texts.append(made)
            taken = batch.take(pa.array(own, pa.int64()))
            done = [taken.column(k) for k in range(len(columns))]
            done[at] = pa.array(texts, pa.string())
            if chars is not None:
                done[chars] = pa.array([len(t) for t in texts], pa.int64()).cast(done[chars].type)
            yield pa.RecordBatch.from_arrays(done, names=columns)

    return joined.mapInArrow(rows, documents.schema)
