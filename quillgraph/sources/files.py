"""Sources and sinks: JSON, JSON lines, delimited text, plain text, model documents, instance datasets; unions of providers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.vocab import FACETS


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir), removed when the driver ends. Where that setting is
    missing, a folder of this machine if all of Spark runs in this process, as in tests; on a cluster other machines wouldn't
    see it, so there the setting is demanded."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
        top = sc.getCheckpointDir()
    path = f"{top.rstrip('/')}/quillgraph-{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and sc._jvm is not None:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts its lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def format_of(path: str) -> str:
    """Format by suffix; anything else is text."""
    return {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "csv": "csv"}.get(path.rsplit(".", 1)[-1].lower(), "text")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """path, body: one JSON document per file, as text that parses (others are dropped)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    return files.where(F.try_parse_json("body").isNotNull())


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """body: the lines that hold a JSON value; blank lines, unparsable lines and null lines are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("body")).where("body != ''")
    return lines.where(F.try_parse_json("body").isNotNull() & ~F.is_variant_null(F.try_parse_json("body")))


#: Files whose headers are broadcast at most; beyond, lines meet them in a shuffle.
MOST_FILES = 100_000


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The wanted columns of delimited text, as trimmed strings, no quoting. Cells go by the header of their own file,
    whatever its order; of a name that occurs twice the last cell counts, missing trailing cells are '', a column that a file
    lacks is NULL, empty lines go."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), "value").where("value != ''")
    # A file's header is the first line of its first block; a line's number grows within a block.
    top = F.min(F.when(F.col("_block") == 0, F.struct("_line", "value")))
    heads = durable(lines.groupBy("_path").agg(top.alias("_top")), "heads")  # read when the source is, as a schema would be
    if heads.count() <= MOST_FILES:
        heads = F.broadcast(heads)
    rows = lines.join(heads, "_path").where("_block != 0 or _line != _top._line")
    split = lambda text: F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    parted = rows.select(split(F.col("value")).alias("_cells"), F.reverse(split(F.col("_top.value"))).alias("_names"))
    place = lambda c: F.array_position("_names", F.lit(c))
    cell = lambda c: F.when(place(c) > 0, F.coalesce(F.get("_cells", (F.size("_names") - place(c)).cast("int")), F.lit("")))
    return parted.select(*[cell(c).alias(c) for c in columns])


def write_csv_lines(lines: DataFrame, path: str, header: str) -> None:
    """Lines (value) as text files, each file with the header first; tasks write their own files."""

    def headed(batches):
        first = True
        for batch in batches:
            values = batch.column(0)
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([header], pa.string())], names=["value"])
                first = False
            yield pa.RecordBatch.from_arrays([values.cast(pa.string())], names=["value"])

    lines.select(F.col("value").cast("string").alias("value")).mapInArrow(headed, "value string").write.text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


# Model documents: nested JSON to the tables of the model.
_FACETS = "struct<" + ", ".join(f"{key}: array<map<string,string>>" for key in FACETS) + ">"
_CONTAINER = f"uri: string, parentUri: string, name: string, description: string, tags: array<string>, facets: {_FACETS}, symbols: array<map<string,string>>"
_LINKS = "array<struct<uri: string, predicate: string, sourceUri: string, targetUri: string, label: string>>"
MODEL_SCHEMA = f"struct<{_CONTAINER}, contexts: map<string, struct<{_CONTAINER}>>, links: {_LINKS}>"


def flatten_models(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contexts, entities and links of documents (map_id, body). One pass of from_json; the root comes first among the
    containers. Entities keep every top-level field as text."""
    parsed = documents.select("map_id", F.from_json("body", MODEL_SCHEMA).alias("d"))
    container = F.struct(*[F.col(f"d.{c}").alias(c) for c in ("uri", "parentUri", "name", "description", "tags", "facets", "symbols")])
    inner = F.coalesce(F.map_values("d.contexts"), F.slice(F.array(container), 1, 0))
    places = parsed.select("map_id", F.explode(F.concat(F.array(container), inner)).alias("c"))
    contexts = places.select("map_id", F.col("c.uri").alias("uri"), F.col("c.parentUri").alias("parent_uri"), F.col("c.name").alias("name"), F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"))
    kinds = F.array(*[F.struct(F.lit(name).alias("class_id"), F.lit(key).alias("facet_key"), F.col(f"c.facets.{key}").alias("rows")) for key, name in FACETS.items()], F.struct(F.lit("Symbol").alias("class_id"), F.lit("symbols").alias("facet_key"), F.col("c.symbols").alias("rows")))
    kinds_of = places.select("map_id", F.col("c.uri").alias("container_uri"), F.explode(kinds).alias("k"))
    rows = kinds_of.select("map_id", "container_uri", "k.class_id", "k.facet_key", F.posexplode("k.rows").alias("ord", "fields"))
    entities = rows.select("map_id", F.col("fields")["uri"].alias("uri"), "class_id", "facet_key", F.lit(False).alias("is_custom"), "container_uri", F.col("fields")["name"].alias("name"), "fields", F.col("ord").cast("long").alias("ord"))
    links = parsed.select("map_id", F.posexplode("d.links").alias("ord", "l")).select("map_id", F.col("l.uri").alias("uri"), F.col("l.predicate").alias("predicate"), F.col("l.sourceUri").alias("source_uri"), F.col("l.targetUri").alias("target_uri"), "ord")
    return contexts, entities, links


INSTANCES_SCHEMA = (
    "mapId string, entities array<struct<id: string, thingId: string, contextId: string, attributes: map<string, struct<type: string, value: string>>>>, "
    "relationships array<struct<id: string, predicate: string, sourceInstanceId: string, targetInstanceId: string>>, "
    "events array<struct<id: string, eventId: string, timestamp: string>>, "
    "measures array<struct<measureId: string, value: double, timestamp: string, dimensions: map<string, string>>>"
)


def flatten_instances(documents: DataFrame) -> dict[str, DataFrame]:
    """entities, relationships, events and measures of instance datasets (body)."""
    parsed = documents.select(F.from_json("body", INSTANCES_SCHEMA).alias("d")).select("d.*")
    return {name: parsed.select(F.col("mapId").alias("map_id"), F.explode(name).alias("r")).select("map_id", "r.*") for name in ("entities", "relationships", "events", "measures")}


def composite(providers: dict[str, DataFrame]) -> DataFrame:
    """All providers' rows, each routed by its Thing; columns that a provider lacks are NULL."""
    routed = [rows.where(F.col("thing_id") == thing) for thing, rows in providers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), routed)


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)
