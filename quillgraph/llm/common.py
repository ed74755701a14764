"""Helpers that the operators share: table readers, durable intermediate tables, prefix sums over hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words, everywhere in this subpackage: ASCII white space. bytes.split() splits on the same set.
SPACE = "\x09\x0a\x0b\x0c\x0d\x20"
#: Words as a pattern for Spark SQL and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where it is unset, a folder of this machine if all of Spark runs in
    this process, as in tests. On a cluster other machines wouldn't see that, so there the setting is demanded."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    return sc.getCheckpointDir().rstrip("/")


#: Options of a table of very large rows (MB each): a row group holds a few, since readers take a whole one at once.
LARGE_ROWS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def materialize(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write df to a Parquet table in the shared folder and read it again: later jobs start from those files, so neither
    a lost executor nor a second use repeats the work. The table goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    atexit.register(drop_path, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jvm is None:  # the session has ended before the interpreter
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


#: Slices that a key is cut into for prefix sums: the same everywhere, so that an order never depends on a session's settings.
SLICES = 8192


def running_start(df: DataFrame, key: str, amount: str, order: list[str], out: str) -> DataFrame:
    """Adds `out`: the sum of `amount` over the rows of the same `key` before this one.

    The order is by a hash slice of `order` and then by `order`, so that it is the same in every run, and a key that
    holds a third of all rows is still spread over all slices: the sums within slices are windows over (key, slice),
    the sums over slices a window over one row per (key, slice).
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)).cast("int"))
    totals = sliced.groupBy(key, "_slice").agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col(key).alias("_key"), F.col("_slice").alias("_in"), F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias("_base"))
    within = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = sliced.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)).cast("long"))
    joined = inner.join(base, inner[key].eqNullSafe(base["_key"]) & (inner["_slice"] == base["_in"]))
    return joined.withColumn(out, F.col("_base") + F.col("_within")).drop("_slice", "_within", "_key", "_in", "_base")


#: Parts that the rows of a hot key are dealt to in meet(): bits of a long.
PARTS = 64


def parts_of(by: str) -> Column:
    """Aggregate: the parts that the rows of a key are dealt to, as the bits of a long."""
    return F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64({by}), {PARTS}) as int)))").alias("_bits")


def meet(rows: DataFrame, one: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """rows, any number for a key, joined with `one`, a few rows for a key. The rows of a key are dealt to PARTS parts by
    a hash of `by`, and the key's rows in `one` are copied to those parts that occur, so a key with a third of all rows is
    spread over PARTS tasks while a key of few rows costs few copies. `one` may bring the parts along, as parts_of gives
    them for the same rows, in the column _bits."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    if "_bits" not in one.columns:
        one = one.join(rows.groupBy(*keys).agg(parts_of(by)), keys)
    copies = F.expr(f"explode(filter(sequence(0, {PARTS - 1}), i -> (shiftrightunsigned(_bits, i) & 1L) = 1L))")
    return dealt.join(one.withColumn("_part", copies).drop("_bits"), [*keys, "_part"], how).drop("_part")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of at most `rows` rows: Python objects are made for one part at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
