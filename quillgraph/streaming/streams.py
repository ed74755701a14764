"""Streaming jobs: continuous mapping, live state, run metrics, windows of measures. All are restartable: progress is in the
checkpoint, sinks are idempotent per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.log import KEY, alive, live
from quillgraph.sources.files import drop


def files(spark: SparkSession, path: str, schema, per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    for name, value in (("maxFilesPerTrigger", per_trigger), ("pathGlobFilter", pattern)):
        if value:
            reader = reader.option(name, value)
    return reader.parquet(path)


#: A run of a table takes in up to this many shorter ones.
FAN = 8
TURN = "_batch"


def runs(spark: SparkSession, out: str, ended: int | None = None) -> list[tuple[int, int]]:
    """The runs of a table, as first and last batch, that were written whole and that no longer run holds; those up to the
    batch `ended`, if it is given."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/run=*/_SUCCESS")
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [f.getPath().getParent().getName().partition("=")[2].split("-") for f in listed]
    found = [(int(a), int(b)) for a, b in names if ended is None or int(b) <= ended]
    return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))


def _rows(spark: SparkSession, out: str, some: list[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(*[f"{out}/run={a}-{b}" for a, b in some])


def kept(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, mode: str = "append", trigger: dict | None = None, shape: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Keeps a table under `out` as runs: batch n writes reduce(its rows, shaped, with their batch in _batch) as the run n-n, and where
    n + 1 divides by a power of FAN, reduce(the runs of that many batches and its own rows) as one run. So what a batch writes
    follows the batch, a row is rewritten once for each power of FAN, and a reader finds few runs.

    A batch that is run again after a loss writes the same run from the same earlier ones: runs taken in are dropped only
    when a later batch begins. `trigger` is that of a stream (processingTime, once, availableNow; default: what is there now).
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        before = runs(spark, out, n - 1)
        drop_runs(spark, out, before, n)
        span = 1
        while (n + 1) % (span * FAN) == 0:
            span *= FAN
        first = n + 1 - span
        rows = (shape(batch) if shape else batch).withColumn(TURN, F.lit(n).cast("long"))
        held = [r for r in before if r[0] >= first]
        rows = rows if not held else rows.unionByName(_rows(spark, out, held))
        reduce(rows).write.mode("overwrite").parquet(f"{out}/run={first}-{n}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drop_runs(spark: SparkSession, out: str, live: list[tuple[int, int]], batch: int) -> None:
    """Removes runs of batches before `batch` that longer ones have taken in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/run=*")
    for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []:
        a, b = map(int, f.getPath().getName().partition("=")[2].split("-"))
        if b < batch and (a, b) not in live:
            drop(spark, f"{out}/run={a}-{b}")


def _last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def newest(spark: SparkSession, out: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows of a table of runs, the last of each key by batch and `order`."""
    return _last(_rows(spark, out, runs(spark, out)), keys, [TURN, *(order or [])]).drop(TURN)


def pipeline(records: DataFrame, mapped: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str], order: list[str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Maps every micro-batch and upserts its rows by key: of a key the last row counts, by batch, then by `order` (columns of
    the mapped rows; default: record_index)."""
    turns = [TURN, *(order or ["record_index"])]
    return kept(records, lambda rows: _last(rows, keys, turns), out, checkpoint, trigger=trigger, shape=mapped)


def state(commands: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Live state of a command stream. Spark's state store holds a row per key (the last upsert and delete, the newest data,
    by sequence, in whatever order commands come); each batch gives out the keys it touched, and only these are written."""
    return kept(live(commands), lambda rows: _last(rows, KEY, [TURN]), out, checkpoint, mode="update", trigger=trigger)


def state_of(spark: SparkSession, out: str) -> DataFrame:
    """type_uri, uri, data, created_at, updated_at of what is alive."""
    return alive(newest(spark, out, KEY))


def windows(made: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Windows of a stream, each written once, when the watermark has passed it."""
    return made.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_metrics(events: DataFrame) -> DataFrame:
    """Per run: events by kind and the last one; an update-mode aggregation whose state is a row per run."""
    kinds = ("started", "fetched", "mapped", "written", "completed", "error")
    return events.groupBy("run_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.max("ts").alias("last_ts"))


def measure_windows(points: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Tumbling windows per measure and dimension: count, sum, average, smallest, largest. In a stream the watermark is one
    window's length (or `late`), and rows that come later than that are dropped."""
    held = points.withWatermark("ts", late or width) if points.isStreaming else points
    grouped = held.groupBy("measure_id", "dimension", F.window("ts", width).alias("w"))
    made = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return made.select("measure_id", "dimension", F.col("w.start").alias("start"), "n", "total", "mean", "low", "high")


#: Values that a quantile sketch keeps at its lowest level: quantiles are exact up to about as many points, then near.
SKETCH = 4096
#: Units of durations in seconds.
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86_400, "weeks": 604_800}
MEASURES = "measure_id string, aggregation string, seconds long, quantile double, low double, high double, direction string"


def measures_table(spark: SparkSession, declared: dict[str, dict]) -> DataFrame:
    """Measures (aggregation, window as (value, unit), quantile, min, max, direction of their target) as a table."""
    rows = []
    for name, spec in declared.items():
        value, unit = spec["window"]
        real = lambda k: None if spec.get(k) is None else float(spec[k])  # noqa: B023, E731
        rows.append((name, spec.get("aggregation", "count"), int(value * UNITS[unit]), real("quantile"), real("min"), real("max"), spec.get("direction")))
    return spark.createDataFrame(rows, MEASURES)


def measure_parts(points: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Small windows per measure and dimension that can be put together to any longer ones: counts, sums, ends and a mergeable
    sketch of the values. In a stream as measure_windows."""
    held = points.withWatermark("ts", late or width) if points.isStreaming else points
    grouped = held.groupBy("measure_id", "dimension", F.window("ts", width).alias("w"))
    made = grouped.agg(F.count("value").alias("n"), F.count_if(F.col("value") != 0).alias("some"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.expr(f"kll_sketch_agg_double(value, {SKETCH})").alias("sketch"))
    return made.select("measure_id", "dimension", F.col("w.start").alias("start"), "n", "some", "total", "least", "most", "sketch")


def declared_windows(parts: DataFrame, measures: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """measure_id, dimension, start, n, value, met: the windows that each measure declares, from small ones (measure_parts), with
    its own aggregation: count, sum, average, min, max, rate (points a second), ratio (the share of points other than 0)
    or percentile. Lengths are multiples of the small windows'; measures that declare nothing have no windows. met: whether
    the value is on the target's good side, or in its range (NULL without a target). quantiles: those that measures may ask for
    (0.95 where they say nothing); another one has no value."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds("start") / F.col("seconds")) * F.col("seconds"))
    placed = parts.join(measures, "measure_id").withColumn("start", start)
    keys = ["measure_id", "dimension", "start", "aggregation", "seconds", "quantile", "low", "high", "direction"]
    sums = [F.sum("n").alias("n"), F.sum("some").alias("some"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")]
    whole = placed.groupBy(*keys).agg(*sums, F.expr("kll_merge_agg_double(sketch)").alias("sketch"))
    kind, n = F.col("aggregation"), F.col("n").cast("double")
    asked = F.create_map(*[x for q in quantiles for x in (F.lit(q), F.expr(f"kll_sketch_get_quantile_double(sketch, {q}D)"))])
    value = (
        F.when(kind == "count", n).when(kind == "sum", F.col("total")).when(kind == "average", F.col("total") / n).when(kind == "min", F.col("least")).when(kind == "max", F.col("most"))
        .when(kind == "rate", n / F.col("seconds")).when(kind == "ratio", F.col("some") / n).when(kind == "percentile", F.element_at(asked, F.coalesce("quantile", F.lit(0.95))))
    )
    whole = whole.where("n > 0").withColumn("value", value)
    above, below = F.col("value") >= F.col("low"), F.col("value") <= F.col("high")
    met = F.when(F.col("direction") == "higher-is-better", above).when(F.col("direction") == "lower-is-better", below).when(F.col("direction") == "range", above & below)
    return whole.select("measure_id", "dimension", "start", "n", "value", met.alias("met"))


def meets_target(windows: DataFrame, column: str, target: float) -> DataFrame:
    return windows.withColumn("met", F.col(column) >= target)


def cursor(spark: SparkSession, records: DataFrame, mark: str | None, key: str) -> DataFrame:
    """Batch counterpart of a stream's checkpoint: records after the persisted mark."""
    return records if mark is None else records.where(F.col(key) > mark)
