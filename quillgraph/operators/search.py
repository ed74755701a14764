"""Search by an index of trigrams: postings (trigram, row) in buckets by trigram, so that a search reads the buckets of its own
trigrams, meets the rows of its rarest ones, and only then looks at texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.sets import found
from quillgraph.sources.files import durable

#: Rows to a bucket, most buckets; the trigrams of a search whose postings are intersected.
ROWS, MOST_BUCKETS, RAREST = 50_000, 4096, 3
#: The tables of an index: what is searched, postings, rows of a trigram.
ROWS_OF = "map_id string, uri string, class_id string, container_uri string, name string, searched string, snippet string, row long, row_bucket int"
POSTINGS, GRAMS = "gram long, row long, row_bucket int, bucket int", "gram long, n long, bucket int"
#: Trigrams that a task gathers before it gives them out.
GATHERED = 1 << 18


def grams_of(text: str) -> np.ndarray:
    """The distinct trigrams of a text, each as its three code points, 21 bits a point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]) if len(points) >= 3 else np.array([], np.int64)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, row, row_bucket of rows (row, row_bucket, searched); some texts' at a time."""

    def made(batch: pa.RecordBatch, at: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
        rows = pa.array(np.repeat(at, [len(g) for g in grams]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["gram", "row", "row_bucket"])

    for batch in batches:
        at, grams, n = [], [], 0
        for k in range(batch.num_rows):
            found = grams_of(batch.column(2)[k].as_py() or "")
            if len(found):
                at.append(k)
                grams.append(found)
                n += len(found)
            if n >= GATHERED:
                yield made(batch, at, grams)
                at, grams, n = [], [], 0
        if n:
            yield made(batch, at, grams)


def _bucket(buckets: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, path: str, buckets: int | None = None) -> None:
    """Writes rows (as sets.searchable gives them), their postings and how many rows each trigram has under `path`. A text is
    encoded once; a trigram counts once a row."""
    spark = rows.sparkSession
    rows = durable(rows, "searchable")
    buckets = buckets or min(MOST_BUCKETS, 1 + rows.count() // ROWS)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/size")
    kept = rows.withColumn("row", F.xxhash64("map_id", "uri", "class_id")).withColumn("row_bucket", _bucket(buckets, "row"))
    kept.repartition("row_bucket", F.pmod("row", F.lit(8))).write.partitionBy("row_bucket").parquet(f"{path}/rows")

    texts = spark.read.schema(ROWS_OF).parquet(f"{path}/rows").select("row", "row_bucket", "searched")
    posted = texts.mapInArrow(_posted, "gram long, row long, row_bucket int").withColumn("bucket", _bucket(buckets, "gram"))
    # A trigram that all rows share spreads over several files of its bucket.
    posted.repartition("bucket", F.pmod("row", F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    counted = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    counted.repartition("bucket").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """row, row_bucket of rows that have the rarest trigrams of `text`; None if it has none. The driver gets a count for each
    trigram of the search, no more."""
    grams = grams_of(text.lower()).tolist()
    if not grams:
        return None
    buckets = spark.read.parquet(f"{path}/size").first()["buckets"]
    asked = spark.createDataFrame([(g,) for g in grams], "gram long").select("gram", _bucket(buckets, "gram").alias("bucket")).collect()
    where = lambda df, some: df.where(F.col("bucket").isin(sorted({r.bucket for r in some})) & F.col("gram").isin([r.gram for r in some]))
    counts = {r.gram: r.n for r in where(spark.read.schema(GRAMS).parquet(f"{path}/grams"), asked).collect()}
    rarest = sorted(asked, key=lambda r: (counts.get(r.gram, 0), r.gram))[:RAREST]
    hits = where(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), rarest)
    return hits.groupBy("row", "row_bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).drop("n")


def search(spark: SparkSession, path: str, text: str, contexts: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """The same rows as sets.search. A search of fewer than three characters has no trigram and reads all rows."""
    rows = spark.read.schema(ROWS_OF).parquet(f"{path}/rows")
    likely = candidates(spark, path, text)
    hits = rows if likely is None else rows.join(likely, ["row_bucket", "row"], "left_semi")
    return found(hits.drop("row", "row_bucket"), text, contexts, classes)
