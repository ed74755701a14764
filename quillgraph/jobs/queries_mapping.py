"""Sources, sinks, record mapping, upserts, validation, model rules, over data that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import json_text, paths
from quillgraph.functions.json_text import field, number_of, string_of
from quillgraph.functions.transforms import Registry
from quillgraph.jobs.model import Model, uri
from quillgraph.jobs.registry import query
from quillgraph.operators import joins, mapping, quality, sets, triples, versions
from quillgraph.sources import documents, files

MAPPING = mapping.Mapping(
    thing="thing:event",
    iterate="$.data",
    filter="$.flag",
    identity="$.id",
    fields={"kind": mapping.Field("$.type", "upper"), "amount": mapping.Field("$.value"), "tier": mapping.Field("$.meta.note", None, '"none"'), "k": mapping.Field("$.meta.k"), "source": mapping.Field('"feed"')},
    links={"byUser": ("thing:user", "$.user")},
)


#: Records of a response; ids of a range that is counted at once.
PAGE, RANGE = 500, 100_000


def numbered(events, range_: int = RANGE):
    """events with n, their number among their user's by event_id, from 0: ranges of ids are counted first, so that no task
    sorts all events of a user."""
    ranged = events.withColumn("_range", F.floor(F.col("event_id") / range_))
    counts = ranged.groupBy("user_id", "_range").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("user_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("user_id", "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("user_id", "_range").orderBy("event_id")
    return ranged.withColumn("_own", F.row_number().over(own) - 1).join(starts, ["user_id", "_range"]).withColumn("n", F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")


def responses(m: Model, page: int = PAGE):
    """JSON responses of users, each a page of at most PAGE of a user's events as records; every 13th lacks its id, every 17th
    its meta; page counts from 0."""
    c = F.col
    record = F.struct(
        F.when(c("event_id") % 13 != 0, F.concat(F.lit("ev"), c("event_id").cast("string"))).alias("id"), c("event_type").alias("type"), c("value"),
        (c("event_type") != "error").alias("flag"), c("user_id").cast("string").alias("user"),
        F.when(c("event_id") % 17 != 0, F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.when(c("event_id") % 3 == 0, F.lit("gold")).alias("note"))).alias("meta"),
    )
    paged = numbered(m.table("events")).withColumn("page", F.floor(c("n") / page).cast("int"))
    rows = paged.groupBy("user_id", "page").agg(F.sort_array(F.collect_list(F.struct("event_id", record.alias("r")))).alias("rows"))
    return rows.select("user_id", "page", F.to_json(F.struct(F.transform("rows", lambda x: x["r"]).alias("data"), (c("user_id") % 2 == 0).alias("more"))).alias("body"))


def records_of(m: Model, path: str, page: int = PAGE):
    """user_id, record_index, record of all pages of a user, counted through."""
    return mapping.iterate(responses(m, page), path).withColumn("record_index", (F.col("page") * page + F.col("record_index")).cast("int")).drop("page")


def mapped(m: Model):
    return mapping.run_mapping(records_of(m, MAPPING.iterate), MAPPING)


EV = """EV AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS record_index,
  CASE WHEN event_type = 'error' THEN 'skipped' WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN event_id % 17 <> 0 THEN CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) END AS k,
  CASE WHEN event_id % 3 = 0 AND event_id % 17 <> 0 THEN 'gold' ELSE 'none' END AS tier FROM events)"""


def bucketed(customers, width: int = 25_000):
    """customers with bucket: ranges of their keys, so that a document holds at most so many, however large a nation is."""
    return customers.withColumn("bucket", F.floor(F.col("c_custkey") / width))


@query("SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def src_json(spark, sf_dir):
    path = files.scratch(spark, "json")
    rows = bucketed(Model(spark, sf_dir).table("customer")).groupBy("c_nationkey", "bucket").agg(F.to_json(F.struct(F.first("c_nationkey").alias("nation"), F.collect_list(F.struct("c_custkey", "c_acctbal")).alias("customers"))).alias("body"))
    rows.write.partitionBy("c_nationkey", "bucket").text(path)
    records = mapping.iterate(files.read_json(spark, path).withColumn("nation", F.get_json_object("body", "$.nation").cast("int")), "$.customers")
    return records.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(number_of(paths.value_at(F.col("record"), "c_acctbal"))), 2).alias("total"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def src_jsonl(spark, sf_dir):
    path = files.scratch(spark, "jsonl")
    rows = Model(spark, sf_dir).table("customer")
    noise = rows.select(F.explode(F.array(F.lit(""), F.lit("null"), F.lit("{broken"), F.lit("  "))).alias("value"))
    rows.select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))).alias("value")).union(noise).write.text(path)
    record = F.parse_json("body")
    return files.read_jsonl(spark, path).select(number_of(paths.value_at(record, "id")).cast("long").alias("id"), string_of(paths.value_at(record, "segment")).alias("segment"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_size > 25 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size FROM part")
def src_csv(spark, sf_dir):
    path = files.scratch(spark, "csv")
    part = Model(spark, sf_dir).table("part")
    line = F.concat_ws(",", F.concat(F.lit("  "), F.col("p_partkey").cast("string")), F.concat(F.col("p_name"), F.lit(" ")), F.when(F.col("p_size") <= 25, F.col("p_size").cast("string")))
    files.write_csv_lines(part.select(line.alias("value")), path, "id,name,size")
    return files.read_csv(spark, path, ["id", "name", "size"])


@query("SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS n FROM documents GROUP BY 1")
def src_text(spark, sf_dir):
    path = files.scratch(spark, "text")
    docs = Model(spark, sf_dir).table("documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.regexp_replace("text", r"[\r\n]", " ")).alias("value"))
    docs.write.partitionBy("source").text(path)
    lines = files.read_text(spark, path).select(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source"), F.explode(F.split(F.regexp_replace("body", "\n\\z", ""), "\n(?=[0-9]+\\|)")).alias("line"))
    chars = F.length(F.regexp_replace("line", r"^[0-9]+\|", ""))
    return lines.groupBy("source").agg(F.sum(chars).alias("chars"), F.count(F.lit(1)).alias("n"))


def model_documents(m: Model, width: int = 25_000):
    """Model documents of nations, each with a range of a nation's customers as personas; the nation's context, the root and
    their link are in all of them."""
    person = F.create_map(F.lit("uri"), uri("persona:c", "c_custkey"), F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    place = F.struct(uri("ctx:n", "c_nationkey").alias("uri"), F.lit("bm:ctx:root").alias("parentUri"), F.first("c_nationkey").cast("string").alias("name"), F.struct(F.collect_list(person).alias("personas")).alias("facets"))
    root = F.struct(F.lit("bm:ctx:root").alias("uri"), F.lit("root").alias("name"), F.create_map(uri("ctx:n", "c_nationkey"), place).alias("contexts"), F.array(F.struct(F.lit("l1").alias("uri"), F.lit("childOf").alias("predicate"), uri("ctx:n", "c_nationkey").alias("sourceUri"), F.lit("bm:ctx:root").alias("targetUri"))).alias("links"))
    return bucketed(m.table("customer"), width).groupBy("c_nationkey", "bucket").agg(F.to_json(root).alias("body")).select(F.concat(F.lit("map"), F.col("c_nationkey").cast("string")).alias("map_id"), "body")


@query("""SELECT 'map' || c_nationkey AS map_id, 'entity' AS kind, 'bm:persona:c' || c_custkey AS uri, 'bm:ctx:n' || c_nationkey AS place, c_mktsegment AS info FROM customer
  UNION ALL SELECT DISTINCT 'map' || c_nationkey, 'context', 'bm:ctx:n' || c_nationkey, 'bm:ctx:root', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT DISTINCT 'map' || c_nationkey, 'context', 'bm:ctx:root', NULL, 'root' FROM customer
  UNION ALL SELECT DISTINCT 'map' || c_nationkey, 'link', 'bm:ctx:n' || c_nationkey, 'bm:ctx:root', 'childOf' FROM customer""")
def src_model(spark, sf_dir):
    contexts, entities, links = files.flatten_models(model_documents(Model(spark, sf_dir)))
    rows = entities.select("map_id", F.lit("entity").alias("kind"), "uri", F.col("container_uri").alias("place"), F.col("fields")["segment"].alias("info"))
    rows = rows.union(contexts.select("map_id", F.lit("context"), "uri", "parent_uri", "name").distinct())
    return rows.union(links.select("map_id", F.lit("link"), "source_uri", "target_uri", "predicate").distinct())


#: Customers whose documents, or rows made of these, a task holds at once.
CUSTOMERS = 20_000


def parts_for(customers) -> int:
    return 1 + customers.count() // CUSTOMERS


def versioned(m: Model, side: str):
    """A version of the whole documents as the rows that are compared, those of a key in one of parts_for() parts: what
    sorts, reduces and joins them holds a part."""
    rows = documents.snapshot(documents.flatten(whole_documents(m, side)))
    return rows.repartition(parts_for(m.table("customer")), *versions.KEY).dropDuplicates(versions.KEY)


def whole_documents(m: Model, side: str = "base", width: int = 5_000):
    """Documents of nations with customers as personas and what else a document may hold: two kinds of custom facets (one is
    declared), workflows with steps, Things with states and references, actions with payloads, notes, links with all they
    carry. side: base, ours or theirs, for versions."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    some = lambda test, row: F.collect_list(F.when(test, row))
    of = lambda **f: F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in f.items()])
    x = F.when(F.lit(side == "ours") & (k % 10 == 0), F.lit(99)).otherwise(k % 7)
    y = F.when(F.lit(side == "theirs") & (k % 4 == 0), F.lit(77)).otherwise(k % 11)
    level = F.when(F.lit(side != "base") & (k % 9 == 0), F.lit({"ours": 50, "theirs": 60}.get(side, 0))).otherwise(k % 5)
    node = some((k % 2 == 0) & ~(F.lit(side == "theirs") & (k % 22 == 0)), of(uri=name("bm:node:", s), name=name("n", s), x=x, y=y))
    risk = some(k % 3 == 0, of(uri=name("bm:risk:", s), tags=F.array(F.lit("hot")), level=level))
    flow = some(k % 4 == 0, of(uri=name("bm:flow:", s), name=name("flow ", s), steps=F.array(of(id=name("bm:step:", s, ":1"), name=F.lit("one")), of(id=name("bm:step:", s, ":2"), name=F.lit(None).cast("string")))))
    states = F.array(of(id=name("bm:state:", s, ":a"), name=F.lit("a"), transitions=F.array(of(targetStateId=name("bm:state:", s, ":b")))), of(id=name("bm:state:", s, ":b"), name=F.lit("b"), transitions=F.lit(None).cast("array<struct<targetStateId: string>>")))
    thing = some(k % 5 == 0, of(uri=name("bm:thing:d", s), name=name("thing ", s), attributes=F.array(of(name="like", type="reference", referencedThingId="bm:thing:x"), of(name="n", type="integer", referencedThingId=F.lit(None).cast("string"))), states=states))
    act = some(k % 6 == 0, of(uri=name("bm:act:", s), name=name("act ", s), payload=F.array(of(name="q", sourceThingId=name("bm:thing:d", s)), of(name="r", sourceThingId=F.lit(None).cast("string"))), requestSchema=F.array(of(name="z", sourceThingId=F.lit("bm:thing:req")))))
    note = some(k % 7 == 0, of(uri=name("bm:sym:", s), content=name("see @[X](entity:bm:persona:c", s, ") and @[Y](entity:z)")))
    link = lambda n: F.when(k % 4 == 0, of(uri=name(f"l{n}:", s), predicate="step:performer", sourceUri=name("bm:step:", s, f":{n}"), targetUri=name("bm:persona:c", s), label="does", description=name("d", s), pattern="p", metadata=of(w=k % 3)))
    persona = F.collect_list(of(uri=name("bm:persona:c", s), name=F.col("c_name"), segment=F.col("c_mktsegment")))
    place = of(uri=name("bm:ctx:n", F.col("c_nationkey").cast("string")), parentUri="bm:ctx:root", name=F.first("c_nationkey").cast("string"), domainType="core", facets=of(personas=persona, workflows=flow, things=thing, actions=act), customFacets=of(canvasNode=node, risks=risk), symbols=note)
    links = F.filter(F.flatten(F.collect_list(F.array(link(1), link(2)))), lambda x: x.isNotNull())
    root = of(uri="bm:ctx:root", name="root", meta=of(createdAt="2024-01-01"), customTypes=F.array(of(id="Risk", pluralKey="risks")), contexts=F.create_map(name("bm:ctx:n", F.col("c_nationkey").cast("string")), place), links=links)
    # The lists of a document are made where its customers have been brought together, for CUSTOMERS or so at a time: lists
    # made in parts, before customers move, would hold all of a file in one task.
    customers = bucketed(m.table("customer"), width)
    placed = customers.repartition(parts_for(customers), "c_nationkey", "bucket")
    rows = files.durable(placed.groupBy("c_nationkey", "bucket").agg(F.to_json(root).alias("body")), "documents")
    return rows.select(name("map", F.col("c_nationkey").cast("string"), "/", F.col("bucket").cast("string")).alias("map_id"), "body")


WHOLE = """CUST AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS s, 'bm:ctx:n' || c_nationkey AS place, c_nationkey, c_name, c_mktsegment FROM customer)"""


@query(f"""WITH {WHOLE} SELECT 'Persona' AS kind, false AS custom, 'bm:persona:c' || s AS uri, place, '"' || c_mktsegment || '"' AS info, NULL AS more FROM CUST
  UNION ALL SELECT 'canvasNode', true, 'bm:node:' || s, place, CAST(k % 7 AS VARCHAR), CAST(k % 11 AS VARCHAR) FROM CUST WHERE k % 2 = 0 UNION ALL SELECT 'Risk', true, 'bm:risk:' || s, place, CAST(k % 5 AS VARCHAR), '["hot"]' FROM CUST WHERE k % 3 = 0
  UNION ALL SELECT 'Workflow', false, 'bm:flow:' || s, place, NULL, NULL FROM CUST WHERE k % 4 = 0 UNION ALL SELECT 'Thing', false, 'bm:thing:d' || s, place, NULL, NULL FROM CUST WHERE k % 5 = 0
  UNION ALL SELECT 'Action', false, 'bm:act:' || s, place, NULL, NULL FROM CUST WHERE k % 6 = 0 UNION ALL SELECT 'Symbol', false, 'bm:sym:' || s, place, NULL, NULL FROM CUST WHERE k % 7 = 0
  UNION ALL SELECT 'link', false, 'l' || n || ':' || s, 'does', 'd' || s || '/p', '{{"w":' || k % 3 || '}}' FROM CUST, (VALUES (1), (2)) t(n) WHERE k % 4 = 0
  UNION ALL SELECT DISTINCT 'Context', false, place, 'bm:ctx:root', '"core"', NULL FROM CUST UNION ALL SELECT DISTINCT 'Context', false, 'bm:ctx:root', NULL, NULL, '{{"createdAt":"2024-01-01"}}' FROM CUST""")
def src_documents(spark, sf_dir):
    """Whole documents to rows: facets of all kinds, with fields that no schema names, and links with all they carry."""
    flat = documents.flatten(whole_documents(Model(spark, sf_dir)))
    at = lambda n: F.element_at("fields", F.lit(n))
    kind = F.col("class_id")
    info = F.when(kind == "Persona", at("segment")).when(kind == "canvasNode", at("x")).when(kind == "Risk", at("level"))
    more = F.when(kind == "canvasNode", at("y")).when(kind == "Risk", at("tags"))
    rows = flat["entities"].select(kind.alias("kind"), F.col("is_custom").alias("custom"), "uri", F.col("container_uri").alias("place"), info.alias("info"), more.alias("more"))
    rows = rows.union(flat["links"].select(F.lit("link"), F.lit(False), "uri", "label", F.concat_ws("/", "description", "pattern"), "metadata"))
    return rows.union(flat["containers"].select(F.lit("Context"), F.lit(False), "uri", "parent_uri", at("domainType"), at("meta")).distinct())


@query(f"""WITH {WHOLE} SELECT 'bm:node:' || s AS uri, 'modified' AS change, 'x' AS fields FROM CUST WHERE k % 10 = 0 AND k % 7 <> 99 UNION ALL SELECT 'bm:risk:' || s, 'modified', 'level' FROM CUST WHERE k % 9 = 0""")
def document_changes(spark, sf_dir):
    """What differs between two versions of whole documents, custom facets too."""
    m = Model(spark, sf_dir)
    base, ours = (versioned(m, side) for side in ("base", "ours"))
    return versions.diff(base, ours).select("uri", F.col("change_type").alias("change"), F.array_join("changed_fields", ",").alias("fields"))


@query(f"""WITH {WHOLE} SELECT 'bm:node:' || s AS uri, CASE WHEN k % 22 = 0 AND k % 10 = 0 THEN 'conflict' WHEN k % 22 = 0 THEN 'removed' WHEN k % 10 = 0 AND k % 4 = 0 THEN 'merged' WHEN k % 10 = 0 THEN 'ours' WHEN k % 4 = 0 THEN 'theirs' ELSE 'keep' END AS outcome FROM CUST WHERE k % 2 = 0
  UNION ALL SELECT 'bm:risk:' || s, CASE WHEN k % 9 = 0 THEN 'conflict' ELSE 'keep' END FROM CUST WHERE k % 3 = 0""")
def document_merge(spark, sf_dir):
    """Custom facets in a three-way merge of whole documents: places move on both sides, levels are in conflict."""
    m = Model(spark, sf_dir)
    sides = [versioned(m, side) for side in ("base", "ours", "theirs")]
    rows = versions.merge(*sides)
    return rows.where(F.col("uri").startswith("bm:node:") | F.col("uri").startswith("bm:risk:")).select("uri", "outcome")


@query(f"""WITH {WHOLE}, R AS (SELECT 'bm:persona:c' || s AS u, place, 'bm:Persona' AS t, c_name AS l FROM CUST UNION ALL SELECT 'bm:risk:' || s, place, 'bm:custom/Risk', 'bm:risk:' || s FROM CUST WHERE k % 3 = 0
    UNION ALL SELECT 'bm:flow:' || s, place, 'bm:Workflow', 'flow ' || s FROM CUST WHERE k % 4 = 0 UNION ALL SELECT 'bm:thing:d' || s, place, 'bm:Thing', 'thing ' || s FROM CUST WHERE k % 5 = 0
    UNION ALL SELECT 'bm:act:' || s, place, 'bm:Action', 'act ' || s FROM CUST WHERE k % 6 = 0 UNION ALL SELECT 'bm:sym:' || s, place, 'bm:Symbol', 'see @[X](entity:bm:persona:c' || s || ') and @[Y](entity:z)' FROM CUST WHERE k % 7 = 0)
  SELECT u AS s, 'rdf:type' AS p, t AS o FROM R UNION ALL SELECT u, 'memberOf', place FROM R UNION ALL SELECT u, 'rdfs:label', l FROM R UNION ALL SELECT 'bm:risk:' || s, 'hasTag', 'hot' FROM CUST WHERE k % 3 = 0
  UNION ALL SELECT 'bm:step:' || s || ':' || n, p, CASE p WHEN 'rdf:type' THEN 'bm:WorkflowStep' WHEN 'memberOf' THEN 'bm:flow:' || s WHEN 'rdfs:label' THEN CASE n WHEN 1 THEN 'one' ELSE 'bm:step:' || s || ':2' END ELSE 'bm:persona:c' || s END FROM CUST, (VALUES (1), (2)) t(n), (VALUES ('rdf:type'), ('memberOf'), ('rdfs:label'), ('step:performer')) v(p) WHERE k % 4 = 0
  UNION ALL SELECT 'bm:flow:' || s, 'workflow:involvesPersona', 'bm:persona:c' || s FROM CUST WHERE k % 4 = 0
  UNION ALL SELECT 'bm:state:' || s || ':' || n, p, CASE p WHEN 'rdf:type' THEN 'bm:ThingState' WHEN 'state:memberOf' THEN 'bm:thing:d' || s ELSE n END FROM CUST, (VALUES ('a'), ('b')) t(n), (VALUES ('rdf:type'), ('state:memberOf'), ('rdfs:label')) v(p) WHERE k % 5 = 0
  UNION ALL SELECT 'bm:state:' || s || ':a', 'state:transitionsTo', 'bm:state:' || s || ':b' FROM CUST WHERE k % 5 = 0 UNION ALL SELECT 'bm:thing:d' || s, 'references', 'bm:thing:x' FROM CUST WHERE k % 5 = 0
  UNION ALL SELECT 'bm:act:' || s, 'derivedPayloadFrom', o FROM CUST, LATERAL (VALUES ('bm:thing:d' || s), ('bm:thing:req')) t(o) WHERE k % 6 = 0 UNION ALL SELECT 'bm:sym:' || s, 'mentions', o FROM CUST, LATERAL (VALUES ('bm:persona:c' || s), ('z')) t(o) WHERE k % 7 = 0""")
def document_triples(spark, sf_dir):
    """Every family of triples of whole documents, row by row (those of contexts, the same in all documents, left out)."""
    rows = triples.document_triples(documents.flatten(whole_documents(Model(spark, sf_dir))))
    return rows.where(~F.col("s").startswith("bm:ctx:"))


@query(f"""WITH {WHOLE} SELECT 'Persona' AS kind, 'bm:' || sha256('copy|bm:persona:c' || s) AS id, 'bm:' || sha256('copy|' || place) AS other, NULL AS third FROM CUST
  UNION ALL SELECT 'Thing', 'bm:' || sha256('copy|bm:thing:d' || s), 'bm:' || sha256('copy|bm:thing:x'), 'bm:' || sha256('copy|bm:state:' || s || ':b') FROM CUST WHERE k % 5 = 0
  UNION ALL SELECT 'Workflow', 'bm:' || sha256('copy|bm:flow:' || s), 'bm:' || sha256('copy|bm:step:' || s || ':1'), NULL FROM CUST WHERE k % 4 = 0
  UNION ALL SELECT 'canvasNode', 'bm:' || sha256('copy|bm:node:' || s), CASE WHEN k % 4 = 0 THEN 'bm:' || sha256('copy|bm:persona:c' || s) ELSE 'bm:gone:' || s END, NULL FROM CUST WHERE k % 2 = 0
  UNION ALL SELECT 'link', 'bm:' || sha256('copy|l' || n || ':' || s), 'bm:' || sha256('copy|bm:step:' || s || ':' || n), 'bm:' || sha256('copy|bm:persona:c' || s) FROM CUST, (VALUES (1), (2)) t(n) WHERE k % 4 = 0""")
def document_copies(spark, sf_dir):
    """Whole documents under fresh ids: references inside fields agree, those to what isn't there stay."""
    flat = documents.flatten(whole_documents(Model(spark, sf_dir)))
    number = F.regexp_extract("uri", "([0-9]+)$", 1)
    shown = F.when(number.cast("long") % 4 == 0, F.concat(F.lit('"bm:persona:c'), number, F.lit('"'))).otherwise(F.concat(F.lit('"bm:gone:'), number, F.lit('"')))
    fields = F.when(F.col("class_id") == "canvasNode", F.map_concat("fields", F.create_map(F.lit("representedBy"), shown))).otherwise(F.col("fields"))
    copy = documents.re_id(flat | {"entities": flat["entities"].withColumn("fields", fields)}, "copy")
    at = lambda n, path: F.get_json_object(F.element_at("fields", F.lit(n)), path)
    kind = F.col("class_id")
    other = F.when(kind == "Persona", F.col("container_uri")).when(kind == "Thing", at("attributes", "$[0].referencedThingId")).when(kind == "Workflow", at("steps", "$[0].id")).otherwise(at("representedBy", "$"))
    third = F.when(kind == "Thing", at("states", "$[0].transitions[0].targetStateId"))
    rows = copy["entities"].where(kind.isin("Persona", "Thing", "Workflow", "canvasNode")).select(kind.alias("kind"), F.col("uri").alias("id"), other.alias("other"), third.alias("third"))
    return rows.union(copy["links"].select(F.lit("link"), "uri", "source_uri", "target_uri"))


@query("""WITH P AS (SELECT c_custkey AS k, 'bm:n:' || c_custkey AS uri, CASE WHEN c_custkey % 3 = 0 THEN 'bm:attachment:' || sha256('bm:n:' || c_custkey) WHEN c_custkey % 3 = 1 THEN 'a' || c_custkey END AS mark FROM customer)
  SELECT uri AS id, 'note' AS kind, mark, CASE WHEN k % 3 = 0 THEN '[{"attachmentId":"' || mark || '","kind":"url"}]' WHEN k % 3 = 1 THEN '[{"attachmentId":"a' || k || '"}]' END AS text FROM P
  UNION ALL SELECT 'l' || k, 'link', CASE WHEN k % 4 = 0 THEN 'own' ELSE mark END, NULL FROM P UNION ALL SELECT 'a' || k, 'action', NULL, '[{"description":"must be ' || k || '","type":"text"},{"stateId":"s","type":"state"}]' FROM P WHERE k % 5 = 0""")
def attachment_lifts(spark, sf_dir):
    """Old notes, annotation links and actions in their new form, twice (the second run changes nothing)."""
    rows, k = Model(spark, sf_dir).table("customer"), F.col("c_custkey")
    s = k.cast("string")
    none, tags = F.lit(None).cast("string"), F.array().cast("array<string>")
    row = lambda df, uri_, class_id, key, fields: df.select(F.lit("m").alias("map_id"), uri_.alias("uri"), F.lit(class_id).alias("class_id"), F.lit(key).alias("facet_key"), F.lit(False).alias("is_custom"), F.lit("r").alias("container_uri"), none.alias("name"), tags.alias("tags"), fields.alias("fields"), k.alias("ord"))
    old = F.create_map(F.lit("attachment"), F.when(k % 3 == 0, '{"kind":"url"}'), F.lit("attachments"), F.when(k % 3 == 1, F.concat(F.lit('[{"attachmentId":"a'), s, F.lit('"}]'))))
    notes = row(rows, uri("n:", "c_custkey"), "Symbol", "symbols", F.map_filter(old, lambda _, v: v.isNotNull()))
    acts = row(rows.where(k % 5 == 0), F.concat(F.lit("a"), s), "Action", "actions", F.create_map(F.lit("preconditions"), F.concat(F.lit('["must be '), s, F.lit('",{"stateId":"s","type":"state"}]'))))
    metadata = F.when(k % 4 == 0, '{"attachmentId":"own"}').when(k % 4 == 1, "{}").when(k % 4 == 2, '{"z":1}')
    links = rows.select(F.lit("m").alias("map_id"), F.concat(F.lit("l"), s).alias("uri"), F.lit("annotates").alias("predicate"), uri("n:", "c_custkey").alias("source_uri"), F.lit("t").alias("target_uri"), metadata.alias("metadata"), F.create_map().cast("map<string,string>").alias("fields"))
    flat = documents.lift_attachments(documents.lift_attachments({"entities": notes.unionByName(acts), "links": links}))
    at = lambda n: F.element_at("fields", F.lit(n))
    kind, mark = F.when(F.col("facet_key") == "symbols", "note").otherwise("action"), F.get_json_object(at("attachments"), "$[0].attachmentId")
    found = flat["entities"].select(F.col("uri").alias("id"), kind.alias("kind"), mark.alias("mark"), F.coalesce(at("attachments"), at("preconditions")).alias("text"))
    return found.union(flat["links"].select("uri", F.lit("link"), F.get_json_object("metadata", "$.attachmentId"), none))


@query("""SELECT 'entities' AS kind, 'bm:inst:' || c_custkey AS id, c_acctbal AS value FROM customer
  UNION ALL SELECT 'relationships', 'bm:rel:' || o_orderkey, NULL FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def src_instances(spark, sf_dir):
    m = Model(spark, sf_dir)
    attributes = F.create_map(F.lit("balance"), F.struct(F.lit("decimal").alias("type"), F.col("c_acctbal").cast("string").alias("value")))
    orders = m.table("orders").groupBy("o_custkey").agg(F.collect_list(F.struct(uri("rel:", "o_orderkey").alias("id"), F.lit("placed").alias("predicate"))).alias("relationships"))
    joined = m.table("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    body = F.to_json(F.struct(F.lit("tpch").alias("mapId"), F.array(F.struct(uri("inst:", "c_custkey").alias("id"), attributes.alias("attributes"))).alias("entities"), "relationships"))
    parts = files.flatten_instances(joined.select(body.alias("body")))
    rows = parts["entities"].select(F.lit("entities").alias("kind"), "id", F.col("attributes")["balance"]["value"].cast("double").alias("value"))
    return rows.unionByName(parts["relationships"].select(F.lit("relationships").alias("kind"), "id", F.lit(None).cast("double").alias("value")))


@query("SELECT 'BUILDING' AS segment, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def sink_json(spark, sf_dir):
    path = files.scratch(spark, "out")
    files.write_json(Model(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), path, "segment")
    return spark.read.schema("id bigint, segment string").json(path).where("segment = 'BUILDING'").select("segment", "id")


def part_triples(m: Model):
    parts = m.parts
    return triples.union(triples.triple(parts, "uri", "rdf:type", F.lit("bm:Thing")), triples.triple(parts, "uri", "rdfs:label", "name"), triples.triple(parts, "uri", "memberOf", "container_uri"), triples.triple(m.extends, "source_uri", "step:extends", "target_uri"))


NS = "https://quillgraph.example/"
TERM = f"'<{NS}entity/' || replace(%s, ':', '%%3A') || '>'"
TYPE, LABEL = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://www.w3.org/2000/01/rdf-schema#label>"
LINES = f"""SELECT {TERM % "s"} AS s, 0 AS f, '{TYPE}' AS p, '<{NS}vocab/Thing>' AS o FROM (SELECT 'bm:thing:p' || p_partkey AS s FROM part)
  UNION ALL SELECT {TERM % "s"}, 3, '{LABEL}', '"' || p_name || '"' FROM (SELECT 'bm:thing:p' || p_partkey AS s, p_name FROM part)
  UNION ALL SELECT {TERM % "s"}, 1, '<{NS}vocab/memberOf>', {TERM % "'bm:ctx:root'"} FROM (SELECT 'bm:thing:p' || p_partkey AS s FROM part)
  UNION ALL SELECT {TERM % "source_uri"}, 4, '<{NS}vocab/step_extends>', {TERM % "target_uri"} FROM X"""


@query(f"WITH T AS ({LINES}) SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM T", "X")
def sink_ntriples(spark, sf_dir):
    path = files.scratch(spark, "nt")
    triples.ntriples(part_triples(Model(spark, sf_dir))).write.text(path)
    return spark.read.text(path)


@query(f"WITH T AS ({LINES}) SELECT s || ' ' || string_agg(CASE WHEN f = 0 THEN 'a' ELSE p END || ' ' || o, ' ;' || chr(10) || '  ' ORDER BY f, o) || ' .' AS value FROM T GROUP BY s", "X")
def sink_turtle(spark, sf_dir):
    return triples.turtle(part_triples(Model(spark, sf_dir))).select("value")


@query("""SELECT '{"@id":"bm:thing:p' || p_partkey || '","@type":"bm:Thing","memberOf":"bm:ctx:root","rdfs:label":"' || p_name || '"' ||
    CASE WHEN target_uri IS NULL THEN '' ELSE ',"step:extends":"' || target_uri || '"' END || '}' AS value FROM part LEFT JOIN X ON source_uri = 'bm:thing:p' || p_partkey""", "X")
def sink_jsonld(spark, sf_dir):
    return triples.jsonld(part_triples(Model(spark, sf_dir))).select("value")


PARTED = f"""{LINES} UNION ALL SELECT {TERM % "'bm:ctx:root'"}, 2, '<{NS}vocab/hasPart>', {TERM % "s"} FROM (SELECT 'bm:thing:p' || p_partkey AS s FROM part)"""


def hub_triples(m: Model):
    """Triples of parts, and one subject that has as many as there are parts."""
    return part_triples(m).unionByName(triples.triple(m.parts, F.lit("bm:ctx:root"), "hasPart", F.col("uri")))


@query(f"""WITH T AS ({PARTED}), O AS (SELECT *, row_number() OVER w AS n, lag(s) OVER w AS a, lead(s) OVER w AS b FROM T WINDOW w AS (ORDER BY rtrim(s, '>'), f, rtrim(o, '>')))
  SELECT n, CASE WHEN a = s THEN '  ' ELSE s || ' ' END || CASE WHEN f = 0 THEN 'a' ELSE p END || ' ' || o || CASE WHEN b = s THEN ' ;' ELSE ' .' END AS value FROM O""", "X")
def sink_turtle_lines(spark, sf_dir):
    """Turtle by a sort: a line a triple, one subject with a fourth of them."""
    return triples.turtle_lines(hub_triples(Model(spark, sf_dir)), 10_000).select(F.col("_n").alias("n"), "value")


@query("""WITH T AS (SELECT 'bm:thing:p' || p_partkey AS s, 0 AS f, '@type' AS p, 'bm:Thing' AS o FROM part UNION ALL SELECT 'bm:thing:p' || p_partkey, 1, 'memberOf', 'bm:ctx:root' FROM part
    UNION ALL SELECT 'bm:thing:p' || p_partkey, 3, 'rdfs:label', p_name FROM part UNION ALL SELECT source_uri, 4, 'step:extends', target_uri FROM X UNION ALL SELECT 'bm:ctx:root', 2, 'hasPart', 'bm:thing:p' || p_partkey FROM part)
  , O AS (SELECT *, row_number() OVER w AS n, coalesce(lag(s) OVER w = s, false) AS same, coalesce(lag(s) OVER w = s AND lag(p) OVER w = p, false) AS again, coalesce(lead(s) OVER w = s, false) AS on_, coalesce(lead(s) OVER w = s AND lead(p) OVER w = p, false) AS more FROM T WINDOW w AS (ORDER BY s, f, o))
  SELECT n, CASE WHEN same THEN '' ELSE '{"@id":"' || s || '"' END || ',' || CASE WHEN again THEN '' ELSE '"' || p || '":' END || CASE WHEN more AND NOT again THEN '[' ELSE '' END || '"' || o || '"' || CASE WHEN again AND NOT more THEN ']' ELSE '' END || CASE WHEN on_ THEN '' ELSE '}' END AS value FROM O""", "X")
def sink_jsonld_lines(spark, sf_dir):
    """JSON-LD by a sort: a line an object."""
    return triples.jsonld_lines(hub_triples(Model(spark, sf_dir)), 10_000).select(F.col("_n").alias("n"), "value")


@query("""SELECT 'vocabulary' AS "graph", count(*) AS n FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'model', 3 * (SELECT count(*) FROM part) + (SELECT count(*) FROM X)
  UNION ALL SELECT 'instances', 8 * (SELECT count(*) FROM customer) + (SELECT count(o_custkey) FROM orders)""", "X")
def sink_trig(spark, sf_dir):
    m = Model(spark, sf_dir)
    vocabulary = triples.triple(m.table("part").select("p_brand").distinct(), F.concat(F.lit("tag:"), "p_brand"), "rdf:type", F.lit("bm:Tag"))
    path = files.scratch(spark, "trig")
    triples.write_trig(triples.trig(vocabulary, part_triples(m), triples.instance_triples(m.instances, m.relationships)), path)
    return spark.read.text(path).groupBy("graph").agg(F.count(F.lit(1)).alias("n"))


# Mapping.
@query(f"WITH {EV} SELECT event_id, event_type AS type, k, CASE WHEN event_id % 13 <> 0 THEN 'ev' || event_id END AS id, 7.0 AS seven FROM EV")
def eval_path(spark, sf_dir):
    records = records_of(Model(spark, sf_dir), "$.data")
    at = lambda p: paths.value_at(F.col("record"), p)
    ids = Model(spark, sf_dir).table("events").select("event_id", "user_id")
    ids = numbered(ids).select("event_id", "user_id", F.col("n").cast("int").alias("record_index"))
    return records.join(ids, ["user_id", "record_index"]).select("event_id", string_of(at("$.type")).alias("type"), number_of(at("meta.k")).alias("k"), string_of(at("id")).alias("id"), number_of(at("7")).alias("seven"))


@query("SELECT user_id, count(*) AS n, CAST(max(event_id) % 2 AS BIGINT) * 0 + count(*) - 1 AS last_index FROM events GROUP BY 1 UNION ALL SELECT user_id, 1, 0 FROM events GROUP BY 1")
def map_iterate(spark, sf_dir):
    both = records_of(Model(spark, sf_dir), "$.data").unionByName(records_of(Model(spark, sf_dir), "$.more").where("record_index = 0").withColumn("user_id", F.col("user_id") + 1_000_000))
    counts = both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("record_index").cast("long").alias("last_index"))
    return counts.withColumn("user_id", F.col("user_id") % 1_000_000)


@query(f"WITH {EV} SELECT status = 'skipped' AS skipped, count(*) AS n FROM EV GROUP BY 1")
def map_filter(spark, sf_dir):
    return mapped(Model(spark, sf_dir)).groupBy((F.col("status") == "skipped").alias("skipped")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT user_id, record_index, 'ev' || event_id AS external_id FROM EV WHERE event_type <> 'error' AND event_id % 13 <> 0")
def map_identity(spark, sf_dir):
    return mapped(Model(spark, sf_dir)).where("status != 'skipped' and external_id is not null").select("user_id", "record_index", "external_id")


@query(f"WITH {EV} SELECT 'ev' || event_id AS external_id, upper(event_type) AS kind, value AS amount, tier, k, 'feed' AS source FROM EV WHERE status = 'ok'")
def map_fields(spark, sf_dir):
    rows = mapped(Model(spark, sf_dir)).where("status = 'ok'")
    return rows.select("external_id", string_of(field("kind")).alias("kind"), number_of(field("amount")).alias("amount"), string_of(field("tier")).alias("tier"), number_of(field("k")).alias("k"), string_of(field("source")).alias("source"))


@query(f"WITH {EV} SELECT 'ev' || event_id AS external_id, 'byUser' AS predicate, 'thing:user' AS target_type, CAST(user_id AS VARCHAR) AS target_external_id FROM EV WHERE status = 'ok'")
def map_links(spark, sf_dir):
    return mapping.mapped_links(mapped(Model(spark, sf_dir))).select("external_id", "predicate", "target_type", "target_external_id")


@query(f"WITH {EV} SELECT user_id, record_index, CASE WHEN event_id % 13 = 0 THEN 'identity' ELSE 'k' END AS error_field, 'missing' AS reason FROM EV WHERE status = 'error'")
def map_errors(spark, sf_dir):
    return mapping.mapping_errors(mapped(Model(spark, sf_dir))).select("user_id", "record_index", "error_field", "reason")


@query(f"""WITH {EV} SELECT 'ev' || event_id AS external_id, upper(event_type) AS type, tier AS note, value FROM EV WHERE status = 'ok'""")
def reverse_map(spark, sf_dir):
    rows = mapping.reverse(mapped(Model(spark, sf_dir)).where("status = 'ok'"), MAPPING)
    record = F.parse_json("payload")
    return rows.select("external_id", string_of(paths.value_at(record, "type")).alias("type"), string_of(paths.value_at(record, "note")).alias("note"), number_of(paths.value_at(record, "value")).alias("value"))


@query("""WITH B AS (SELECT user_id, event_type AS kind, value, event_id FROM events WHERE user_id % 3 <> 0), T AS (SELECT c_custkey AS user_id, 'old' AS kind, c_acctbal AS value FROM customer WHERE c_custkey < 100)
  SELECT CAST(user_id AS VARCHAR) AS external_id, kind, value FROM T WHERE user_id NOT IN (SELECT user_id FROM B)
  UNION ALL SELECT CAST(user_id AS VARCHAR), arg_max(kind, event_id), arg_max(value, event_id) FROM B GROUP BY user_id""")
def upsert_latest(spark, sf_dir):
    m = Model(spark, sf_dir)
    shape = lambda df, key, kind, value: df.select(F.lit("t").alias("type_uri"), F.col(key).cast("string").alias("external_id"), kind.alias("kind"), F.col(value).alias("value"))
    batch = m.table("events").where("user_id % 3 != 0").select("event_id", F.lit("t").alias("type_uri"), F.col("user_id").cast("string").alias("external_id"), F.col("event_type").alias("kind"), "value")
    target = shape(m.table("customer").where("c_custkey < 100"), "c_custkey", F.lit("old"), "c_acctbal")
    return mapping.upsert(target, batch, ["event_id"]).select("external_id", "kind", "value")


@query("""SELECT 'thing:' || c_nationkey AS thing_id, 'new' AS version, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1
  UNION ALL SELECT 'thing:' || c_nationkey, 'old', count(*) FROM customer WHERE c_nationkey % 2 = 1 GROUP BY 1""")
def full_refresh(spark, sf_dir):
    rows = Model(spark, sf_dir).table("customer").select(F.concat(F.lit("thing:"), F.col("c_nationkey").cast("string")).alias("thing_id"), "c_nationkey")
    ok = rows.distinct().select("thing_id", (F.col("c_nationkey") % 2 == 0).alias("ok"))
    done = mapping.full_refresh(rows.select("thing_id", F.lit("old").alias("version")), rows.select("thing_id", F.lit("new").alias("version")), ok)
    return done.groupBy("thing_id", "version").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'bm:inst:' || c_custkey AS id, round(10000 / c_nationkey, 6) AS ratio, lower(c_mktsegment) AS label FROM customer WHERE c_nationkey <> 0")
def computed_entities(spark, sf_dir):
    value = lambda n: F.element_at("attributes", F.lit(n))["value"]
    columns = {"ratio": F.round(F.try_divide(F.lit(10000.0), number_of(value("nation"))), 6), "label": F.lower(string_of(value("segment")))}
    return mapping.computed(Model(spark, sf_dir).instances, columns)


@query("""SELECT 'bm:inst:' || c_custkey AS id, CASE WHEN n IS NULL THEN c_mktsegment ELSE 'NEW' END AS segment, c_name AS name, CASE WHEN n IS NULL THEN 1700000000 + c_custkey % 977 ELSE 1800000000 + n END AS updated_at
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def patch_instances(spark, sf_dir):
    m = Model(spark, sf_dir)
    changed = F.create_map(F.lit("segment"), F.struct(F.lit("enum").alias("type"), F.lit('"NEW"').alias("value")))
    changes = m.table("orders").where("o_orderstatus = 'P'").select(uri("inst:", "o_custkey").alias("id"), changed.alias("changed"), (F.lit(1_800_000_000) + F.col("o_orderkey")).alias("updated_at"))
    done = mapping.patch(m.instances.withColumn("updated_at", F.col("created_at")), changes)
    value = lambda n: string_of(F.element_at("attributes", F.lit(n))["value"])
    return done.select("id", value("segment").alias("segment"), value("name").alias("name"), F.col("updated_at").cast("long").alias("updated_at"))


@query("""SELECT 'instance' AS kind, 'bm:inst:' || c_custkey AS id FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'relationship', 'bm:rel:' || o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def delete_instances(spark, sf_dir):
    m = Model(spark, sf_dir)
    gone = m.table("customer").where("c_acctbal < 0").select(uri("inst:", "c_custkey").alias("id"))
    instances, relationships = mapping.delete(m.instances.select("id"), m.relationships, gone)
    return instances.select(F.lit("instance").alias("kind"), "id").union(relationships.select(F.lit("relationship"), "id"))


@query(f"""WITH {EV} SELECT 'pipe:' || (user_id % 4) AS pipeline, 'ev' || event_id AS external_id, upper(event_type) AS type FROM EV WHERE status = 'ok' AND user_id % 5 < 4 AND user_id % 4 <> 3""")
def writeback_queue(spark, sf_dir):
    rows = mapped(Model(spark, sf_dir)).where("status = 'ok' and user_id % 5 < 4").withColumn("type_uri", F.concat(F.lit("type:"), (F.col("user_id") % 4).cast("string"))).withColumn("sequence", F.col("record_index"))
    pipelines = spark.range(4).select(F.concat(F.lit("type:"), F.col("id").cast("string")).alias("type_uri"), F.concat(F.lit("pipe:"), F.col("id").cast("string")).alias("pipeline"), F.when(F.col("id") == 3, "simulation").otherwise("prod").alias("env"))
    queued = mapping.writeback_queue(rows, pipelines.where("env = 'prod'").select("type_uri", "pipeline"), MAPPING)
    return queued.select("pipeline", "external_id", string_of(paths.value_at(F.parse_json("payload"), "type")).alias("type"))


@query(f"""WITH {EV} SELECT user_id, count(*) AS fetched, count(*) FILTER (status = 'ok') AS mapped, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors,
  CASE WHEN count(*) FILTER (status = 'error') = 0 THEN 'ok' WHEN count(*) FILTER (status = 'ok') = 0 THEN 'failed' ELSE 'partial' END AS status FROM EV GROUP BY 1""")
def run_report(spark, sf_dir):
    return mapping.run_report(mapped(Model(spark, sf_dir)), "user_id").select("user_id", "fetched", "mapped", "skipped", "errors", "status")


@query(f"""WITH {EV} SELECT 'ev' || event_id AS external_id, CAST(user_id AS VARCHAR) AS target_external_id, CASE WHEN user_id % 2 = 0 THEN 'bm:user:' || user_id END AS target_uri FROM EV WHERE status = 'ok'""")
def link_resolution(spark, sf_dir):
    m = Model(spark, sf_dir)
    users = m.table("events").where("user_id % 2 = 0").select(F.lit("thing:user").alias("type_uri"), F.col("user_id").cast("string").alias("external_id"), uri("user:", "user_id").alias("uri")).distinct()
    found, pending = joins.resolve_links(mapping.mapped_links(mapped(m)), users)
    return found.select("external_id", "target_external_id", "target_uri").unionByName(pending.select("external_id", "target_external_id", F.lit(None).cast("string").alias("target_uri")))


@query("""SELECT p_brand AS type_uri, 'pipe:' || min(p_partkey) AS pipeline FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0 GROUP BY 1""")
def populating_pipeline(spark, sf_dir):
    part = Model(spark, sf_dir).table("part")
    name = F.concat(F.lit("pipe:"), F.col("p_partkey").cast("string"))
    pipelines = part.select(name.alias("pipeline"), (F.col("p_size") % 2 == 0).alias("two_way"), (F.col("p_size") % 3 == 0).alias("writeback"))
    return joins.populating_pipeline(pipelines, part.select(name.alias("pipeline"), F.col("p_brand").alias("type_uri"), F.col("p_partkey").alias("ord")))


@query("SELECT 'bm:inst:' || c_custkey AS id, upper(c_mktsegment) || '!' AS label, CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM customer")
def transform_registry(spark, sf_dir):
    registry = Registry()
    registry.register("shout", lambda x: json_text.quoted(F.concat(string_of(registry.call("upper", x)), F.lit("!"))))
    registry.register_python("parity", lambda x: '"even"' if int(x) % 2 == 0 else '"odd"')
    value = lambda n: F.element_at("attributes", F.lit(n))["value"]
    return Model(spark, sf_dir).instances.select("id", string_of(registry.call("shout", value("segment"))).alias("label"), string_of(registry.call("parity", value("nation"))).alias("parity"))


# Validation and rules.
DECLARED = {
    "thing:customer": {
        "name": {"type": "text", "required": True, "regex": r"^Customer#\d*[02468]$"},
        "balance": {"type": "decimal", "low": 0.0, "high": 9000.0},
        "segment": {"type": "text"},
        "email": {"type": "email", "required": False, "value_type": "email"},
        "phone": {"type": "text", "required": True},
    }
}
FAULTS = """SELECT 'bm:inst:' || c_custkey AS id, 'name' AS attribute, 'regex' AS fault FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT 'bm:inst:' || c_custkey, 'balance', 'range' FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000
  UNION ALL SELECT 'bm:inst:' || c_custkey, 'segment', 'type' FROM customer UNION ALL SELECT 'bm:inst:' || c_custkey, 'phone', 'required' FROM customer
  UNION ALL SELECT 'bm:inst:' || c_custkey, 'nation', 'unknown' FROM customer"""


@query(FAULTS)
def validate_instances(spark, sf_dir):
    return quality.validate_instances(Model(spark, sf_dir).instances, DECLARED)


@query(f"WITH F AS ({FAULTS}) SELECT id, attribute, fault FROM F WHERE CAST(substr(id, 9) AS BIGINT) % 3 <> 0 UNION ALL SELECT 'bm:inst:' || c_custkey, NULL, 'interface' FROM customer WHERE c_custkey % 3 = 0")
def validate_forms(spark, sf_dir):
    rows = Model(spark, sf_dir).instances.withColumn("interface_id", F.when(F.substring("id", 9, 20).cast("long") % 3 == 0, "form:none").otherwise("form:customer")).drop("thing_id")
    return quality.validate_forms(rows, {"form:customer": "thing:customer"}, DECLARED)


@query("SELECT p_partkey AS id, CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2') THEN 'enum' END AS brand, CASE WHEN p_size > 30 OR p_size < 5 THEN 'range' END AS size, CASE WHEN length(p_name) > 9 THEN 'length' END AS name FROM part")
def check_constraints(spark, sf_dir):
    test = quality.constraint_fault
    return Model(spark, sf_dir).parts.select(F.col("ord").alias("id"), test(field("brand"), enum=["Brand#1", "Brand#2"]).alias("brand"), test(field("size"), low=5, high=30).alias("size"), test(field("name"), longest=9).alias("name"))


@query("SELECT DISTINCT uri AS entity, 'no performs' AS message FROM C WHERE parent_uri IS NOT NULL AND uri NOT IN (SELECT 'bm:ctx:n' || c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey)", "C")
def rule_requires_link(spark, sf_dir):
    return quality.requires_link(Model(spark, sf_dir), "performs").select("entity", "message")


@query("SELECT uri AS entity, 'no tag region' AS message FROM C WHERE parent_uri IS NOT NULL AND tag <> 'region'", "C")
def rule_requires_tag(spark, sf_dir):
    return quality.requires_tag(Model(spark, sf_dir), "region").select("entity", "message")


RULES = """R AS (SELECT uri AS entity, 'no outgoing performs' AS message FROM E WHERE class_id = 'Persona' AND uri NOT IN (SELECT source_uri FROM L WHERE predicate = 'performs')
  UNION ALL SELECT uri, 'no incoming performs' FROM E WHERE class_id = 'Action' AND uri NOT IN (SELECT target_uri FROM L WHERE predicate = 'performs')
  UNION ALL SELECT uri, 'no outgoing reads' FROM E WHERE class_id = 'Action' AND uri NOT IN (SELECT source_uri FROM L WHERE predicate = 'reads')
  UNION ALL SELECT uri, 'no outgoing emits' FROM E WHERE class_id = 'Action')"""
DEFINED = "SELECT 'bm:thing:p' || p_partkey AS entity, 'no definition' AS message FROM part WHERE p_size % 3 <> 2"


@query(f"WITH {RULES} SELECT entity, message FROM R", "E L")
def rule_entity_links(spark, sf_dir):
    m = Model(spark, sf_dir)
    return quality.requires_entity_links(m.entities, m.linked(quality.ASKED), quality.default_rules(spark)).select("entity", "message")


@query(DEFINED)
def rule_requires_field(spark, sf_dir):
    return quality.requires_field(Model(spark, sf_dir).entities, "definition", "Thing").select("entity", "message")


@query(f"WITH {RULES} SELECT message, count(*) AS n FROM (SELECT * FROM R UNION ALL {DEFINED}) GROUP BY 1", "E L")
def default_rules(spark, sf_dir):
    return quality.default_gaps(Model(spark, sf_dir)).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def user_gaps(m: Model):
    return quality.requires_field(m.parts.where(number_of(field("size")) > 25), "definition", "Thing", "error").unionByName(quality.requires_tag(m, "region"))


@query(f"""WITH {RULES} SELECT entity, message, 'error' AS severity FROM ({DEFINED} AND p_size > 25) UNION ALL SELECT uri, 'no tag region', 'warning' FROM C WHERE parent_uri IS NOT NULL AND tag <> 'region'
  UNION ALL SELECT entity, message, 'warning' FROM R UNION ALL SELECT entity, message, 'info' FROM ({DEFINED} AND p_size <= 25)""", "C E L")
def all_gaps(spark, sf_dir):
    m = Model(spark, sf_dir)
    return quality.all_gaps(user_gaps(m), quality.default_gaps(m)).select("entity", "message", "severity")


@query(f"WITH {RULES} SELECT entity, message FROM R WHERE entity IN (SELECT 'bm:action:o' || o_orderkey FROM orders WHERE o_orderstatus = 'P')", "E L")
def gaps_for_changes(spark, sf_dir):
    m = Model(spark, sf_dir)
    added = m.orders.where(sets.compare("status", "eq", "P")).select("map_id", "uri")
    return quality.gaps_for_changes(m, added).select("entity", "message")


@query(f"""WITH {RULES}, G AS (SELECT entity, 'warning' AS s FROM R UNION ALL SELECT entity, 'info' FROM ({DEFINED})),
  A AS (SELECT container_uri, count(*) AS entities FROM E GROUP BY 1), B AS (SELECT container_uri, count(*) FILTER (s = 'warning') AS warnings, count(*) AS total FROM G JOIN E ON E.uri = G.entity GROUP BY 1)
  SELECT A.container_uri, entities, coalesce(warnings, 0) AS warnings, coalesce(total, 0) AS total, CASE WHEN warnings > 3 THEN 'sketched' WHEN warnings > 0 OR total > 5 THEN 'structured' ELSE 'rich' END AS level FROM A LEFT JOIN B USING (container_uri)""", "E L")
def violation_rollup(spark, sf_dir):
    m = Model(spark, sf_dir)
    done = quality.rollup(quality.default_gaps(m), m.entities)
    return done.select("container_uri", "entities", "warnings", "total", F.coalesce("level", F.lit("rich")).alias("level"))


@query(f"""WITH {RULES}, G AS (SELECT entity, message, 'entity-links' AS rule, 1 AS r FROM R UNION ALL SELECT entity, message, 'requires-field', 2 FROM ({DEFINED}))
  SELECT entity, message, (SELECT count(*) FROM G) - 5 AS more FROM (SELECT * FROM G ORDER BY r, rule, entity, message LIMIT 5)""", "E L")
def top_gaps(spark, sf_dir):
    return quality.top_gaps(quality.default_gaps(Model(spark, sf_dir))).select("entity", "message", "more")


@query("SELECT uri AS id FROM E WHERE uri NOT IN (SELECT source_uri FROM L) AND uri NOT IN (SELECT target_uri FROM L)", "E L")
def orphan_entities(spark, sf_dir):
    m = Model(spark, sf_dir)
    return quality.orphan_entities(m.entities, m.linked()).select(F.col("uri").alias("id"))


@query("SELECT 'bm:thing:p' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (1, 2))")
def orphan_parts(spark, sf_dir):
    """Parts that neither of two suppliers stewards."""
    m = Model(spark, sf_dir)
    links = m.links.where("predicate = 'stewards' and source_uri in ('bm:persona:s1', 'bm:persona:s2')")
    return quality.orphan_entities(m.parts, links).select(F.col("uri").alias("id"))


@query("""SELECT uri AS entity, 'no definition' AS message, 'error' AS severity FROM E JOIN part ON uri = 'bm:thing:p' || p_partkey WHERE tag = 'Brand#11' AND p_size % 3 <> 2
  UNION ALL SELECT uri, 'no stewards', 'warning' FROM E WHERE class_id = 'Thing' AND uri NOT IN (SELECT target_uri FROM L WHERE predicate = 'stewards')
  UNION ALL SELECT uri, 'no segment', 'info' FROM E WHERE uri NOT LIKE 'bm:persona:c%'""", "E L")
def selected_gaps(spark, sf_dir):
    """User rules with every selector; one of them is switched off."""
    rules = [
        {"kind": "requires-field", "field": "definition", "selector": "tagged", "value": "Brand#11", "severity": "error"},
        {"kind": "requires-link", "predicate": "stewards", "selector": "entityType", "value": "Thing"},
        {"kind": "requires-field", "field": "segment", "severity": "info"},
        {"kind": "requires-field", "field": "nothing", "enabled": False},
    ]
    return quality.rule_gaps(Model(spark, sf_dir), rules).select("entity", "message", "severity")


def ports(m: Model):
    """Every region and nation as a port of itself; those with an even key take part in nothing."""
    return m.contexts.where("parent_uri is not null").select("map_id", "uri", F.col("uri").alias("container_uri"))


@query("""SELECT uri AS id, 'no-value-stream' AS pattern FROM C WHERE parent_uri IS NOT NULL AND uri NOT IN (SELECT source_uri FROM V) AND uri NOT IN (SELECT target_uri FROM V)
  UNION ALL SELECT uri, 'no-payload' FROM C WHERE parent_uri IS NOT NULL AND uri NOT IN (SELECT 'bm:ctx:n' || c_nationkey FROM customer WHERE c_acctbal > 9900)""", "C V")
def port_patterns(spark, sf_dir):
    m = Model(spark, sf_dir)
    produces = m._links(m.table("customer").where("c_acctbal > 9900"), F.lit("produces"), uri("ctx:n", "c_nationkey"), uri("thing:p", "c_custkey"))
    return quality.port_patterns(ports(m), m.links.unionByName(produces)).select(F.col("uri").alias("id"), "pattern")


@query("""SELECT L.source_uri, L.predicate, L.target_uri FROM L JOIN N s ON s.uri = L.source_uri JOIN N t ON t.uri = L.target_uri
  WHERE L.predicate NOT IN ('valueStream', 'extends') AND s.container_uri <> t.container_uri AND s.container_uri IN ('bm:ctx:n1', 'bm:ctx:n2', 'bm:ctx:n3')""", "N L")
def bypassed_ports(spark, sf_dir):
    m = Model(spark, sf_dir)
    some = ports(m).where("uri in ('bm:ctx:n1', 'bm:ctx:n2', 'bm:ctx:n3')")
    return quality.bypassed_ports(m.links, joins.named(m), some).select("source_uri", "predicate", "target_uri")


@query("SELECT 'bm:thing:p' || p_partkey AS id, CASE WHEN 'bm:thing:p' || p_partkey IN (SELECT target_uri FROM X) THEN 'part' ELSE 'root' END AS role FROM part", "X")
def infer_roles(spark, sf_dir):
    m = Model(spark, sf_dir)
    owns = m.extends.withColumn("predicate", F.lit("owns"))
    return quality.infer_roles(m.parts.select("map_id", "uri"), owns).select(F.col("uri").alias("id"), "role")


@query("SELECT 'bm:inst:' || c_custkey AS what, 'error' AS severity FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'map' || r_regionkey, 'warning' FROM region WHERE r_regionkey > 2")
def bundle_check(spark, sf_dir):
    m = Model(spark, sf_dir)
    instances = m.instances.withColumn("thing_id", F.when(F.col("context_id") != "bm:ctx:n4", F.col("thing_id")))
    models = m.table("region").select(F.concat(F.lit("map"), F.col("r_regionkey").cast("string")).alias("map_id"), F.when(F.col("r_regionkey") <= 2, F.lit("2024-01-01")).alias("created_at"))
    return quality.bundle_check(instances, models)
