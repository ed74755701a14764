"""Sets, filters, joins and aggregates over the model tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillgraph.functions.json_text import field, number_of, string_of
from quillgraph.jobs.model import Model, uri
from quillgraph.jobs.registry import query
from quillgraph.operators import joins, search, sets
from quillgraph.sources import files


def out(df):
    return df.select("id")


@query("SELECT uri AS id FROM E WHERE class_id = 'Persona'", "E")
def set_base(spark, sf_dir):
    return out(sets.base(Model(spark, sf_dir), "personas"))


@query("SELECT uri AS id FROM E WHERE container_uri = 'bm:ctx:n3'", "E")
def set_context(spark, sf_dir):
    return out(sets.in_context(Model(spark, sf_dir), "bm:ctx:n3"))


@query("SELECT uri AS id FROM E WHERE tag = 'BUILDING' UNION ALL SELECT uri FROM C WHERE tag = 'BUILDING'", "E C")
def set_tagged(spark, sf_dir):
    return out(sets.tagged(Model(spark, sf_dir), "BUILDING"))


@query("SELECT 'bm:persona:c' || c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey * 2 FROM orders)")
def set_ids(spark, sf_dir):
    m = Model(spark, sf_dir)
    wanted = m.table("orders").select(F.lit("tpch").alias("map_id"), F.concat(F.lit("bm:persona:c"), (F.col("o_custkey") * 2).cast("string")).alias("id"))
    return out(sets.with_ids(m.entities, wanted))


@query("SELECT 'bm:thing:p' || p_partkey AS id FROM part WHERE p_size >= 20 AND p_retailprice < 1500 AND p_brand <> 'Brand#11'")
def flt_compare(spark, sf_dir):
    m = Model(spark, sf_dir)
    test = sets.all_of(sets.compare("size", "gte", 20), sets.compare("price", "lt", 1500), sets.compare("brand", "neq", "Brand#11"))
    return out(sets.ids(sets.where(m.parts, test)))


@query("SELECT 'bm:thing:p' || p_partkey AS id FROM part WHERE contains(p_type, 'E') AND starts_with(p_brand, 'Brand#') AND regexp_matches(p_name, '^[a-z]+ .*[gt]$')")
def flt_text(spark, sf_dir):
    test = sets.all_of(sets.text_test("type", "contains", "E"), sets.text_test("brand", "startsWith", "Brand#"), sets.text_test("name", "regex", "^[a-z]+ .*[gt]$"))
    return out(sets.ids(sets.where(Model(spark, sf_dir).parts, test)))


@query("SELECT 'bm:thing:p' || p_partkey AS id, p_size % 3 = 0 AS missing FROM part WHERE p_size IN (3, 7, 9, 12) OR p_size % 3 = 0")
def flt_in_null(spark, sf_dir):
    rows = Model(spark, sf_dir).parts.where(sets.any_of(sets.one_of("size", [3, 7, 9, 12]), sets.is_null("definition")))
    return rows.select(F.col("uri").alias("id"), sets.is_null("definition").alias("missing"))


@query("SELECT 'bm:persona:c' || c_custkey AS id FROM customer WHERE NOT (c_acctbal > 0 AND c_mktsegment = 'BUILDING') UNION ALL SELECT 'bm:persona:s' || s_suppkey FROM supplier")
def flt_bool(spark, sf_dir):
    test = ~sets.all_of(sets.compare("acctbal", "gt", 0), sets.compare("segment", "eq", "BUILDING"))
    m = Model(spark, sf_dir)
    return out(sets.ids(sets.where(m.customers.unionByName(m.suppliers), test)))


@query("SELECT 'bm:persona:c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT 'bm:persona:s' || s_suppkey FROM supplier")
def flt_tag_kind(spark, sf_dir):
    return out(sets.ids(sets.where(Model(spark, sf_dir).entities, sets.any_of(sets.has_tag("MACHINERY"), sets.has_kind("external")))))


@query("SELECT C.uri AS id, count(E.uri) AS n FROM C LEFT JOIN E ON E.container_uri = C.uri AND E.class_id = 'Persona' WHERE C.parent_uri IS NOT NULL GROUP BY C.uri HAVING count(E.uri) < 60", "C E")
def flt_facet_count(spark, sf_dir):
    return sets.facet_count(Model(spark, sf_dir), "Persona", "lt", 60).select("id", F.col("n").cast("long").alias("n"))


@query("SELECT 'bm:inst:' || c_custkey AS id FROM customer WHERE c_acctbal > 1000 AND contains(CAST(c_nationkey AS VARCHAR), '1') AND c_mktsegment <> 'BUILDING'")
def flt_m0(spark, sf_dir):
    test = sets.all_of(sets.runtime_compare("balance", "gt", 1000), sets.runtime_compare("nation", "contains", "1"), sets.runtime_compare("segment", "neq", "BUILDING"))
    return Model(spark, sf_dir).instances.where(test).select("id")


@query("""SELECT DISTINCT 'bm:action:o' || o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND o_orderstatus <> 'F'""")
def query_builder(spark, sf_dir):
    m = Model(spark, sf_dir)
    persons = sets.Query.of(m, "personas").where({"segment": "BUILDING", "acctbal": {"gte": 0}}).traverse("performs", "out", 1)
    closed = sets.Query.of(m, "Action").where({"status": {"in": ["F"]}})
    return out(persons.subtract(closed).rows)


@query("""SELECT E.uri AS id, E.name, E.class_id, C.name AS context_name FROM E LEFT JOIN C ON C.uri = E.container_uri WHERE contains(lower(E.name), '#0000001')
  UNION ALL SELECT uri, name, 'Context', NULL FROM C WHERE parent_uri IS NOT NULL AND contains(lower(name), '#0000001')""", "C E")
def search_entities(spark, sf_dir):
    m = Model(spark, sf_dir)
    return sets.search(m, "#0000001", ["Persona", "Thing", "Action", "Context"]).select("id", "name", "class_id", "context_name")


@query("""WITH S AS (SELECT 'bm:thing:p' || p_partkey AS id, p_name AS name, 'Thing' AS class_id, 'root' AS context_name, CASE p_size % 3 WHEN 2 THEN p_type WHEN 1 THEN ' ' ELSE '' END AS snippet,
      lower(p_name || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE ' ' || p_type END || ' ' || p_type || ' grade ' || p_brand || ' size ' || p_size || ' or less') AS searched FROM part
    UNION ALL SELECT 'bm:symbol:d' || doc_id, left(text, 80), 'Symbol', 'root', left(text, 100), lower(text) FROM documents
    UNION ALL SELECT C.uri, C.name, 'Context', P.name, '', lower(C.name) FROM C JOIN C P ON P.uri = C.parent_uri)
  SELECT q, id, name, class_id, context_name, snippet FROM S, (SELECT unnest(['grade brand#1', 'SIZE 4', 'ia', 'rica', 'the ', 'no such thing']) AS q) WHERE contains(searched, lower(q))""", "C")
def search_index(spark, sf_dir):
    """Searches by an index over parts (with attributes and rules), documents as notes and contexts."""
    m = Model(spark, sf_dir)
    c = F.col
    text = lambda name: string_of(F.element_at("fields", F.lit(name)))
    attributes = F.to_json(F.array(F.struct(text("type").alias("name")), F.struct(F.concat(F.lit("grade "), text("brand")).alias("name"))))
    rules = F.to_json(F.array(F.concat(F.lit("size "), F.element_at("fields", F.lit("size"))), F.lit("or less")))
    m.entities = m.parts.withColumn("fields", F.map_concat("fields", F.create_map(F.lit("attributes"), attributes, F.lit("rules"), rules)))
    path = files.scratch(spark, "index")
    search.write_index(sets.searchable(m), path)
    found = [search.search(spark, path, q, m.contexts).withColumn("q", F.lit(q)) for q in ("grade brand#1", "SIZE 4", "ia", "rica", "the ", "no such thing")]
    rows = reduce(lambda a, b: a.unionByName(b), found)
    return rows.select("q", "id", "name", "class_id", "context_name", "snippet")


@query("SELECT 'bm:inst:' || c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation, CAST(1700000000 + c_custkey % 977 AS BIGINT) AS updated_at FROM customer")
def typed_instances(spark, sf_dir):
    from quillgraph.operators.quality import typed

    rows = typed(Model(spark, sf_dir).instances, {"name": "text", "balance": "decimal", "segment": "enum", "nation": "integer"})
    return rows.select("id", "name", "balance", "segment", "nation", F.col("updated_at").cast("long").alias("updated_at"))


@query("SELECT 'bm:inst:' || c_custkey AS id FROM customer")
def find_by_thing(spark, sf_dir):
    return sets.find_by_thing(Model(spark, sf_dir).instances, "thing:customer").select("id")


@query("SELECT 'bm:inst:' || c_custkey AS id, 'bm:ctx:n' || c_nationkey AS context_id FROM customer WHERE c_custkey = 17")
def find_by_id(spark, sf_dir):
    return sets.find_by_id(Model(spark, sf_dir).instances, "thing:customer", "bm:inst:17").select("id", "context_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'simulation' ELSE 'prod' END AS env FROM part
  WHERE NOT (p_size % 4 = 0 AND p_size % 5 <> 0)""")
def guard_writes(spark, sf_dir):
    from quillgraph.operators.mapping import guard

    part = Model(spark, sf_dir).table("part")
    writes = part.select(F.col("p_partkey").alias("id"), F.when(F.expr("p_size % 4 = 0"), "simulation").alias("pipeline_env"), F.when(F.expr("p_size % 2 = 1"), "prod").alias("source_env"), F.lit("prod").alias("target_env"), F.expr("p_size % 5 = 0").alias("target_accepts"))
    allowed, _ = guard(writes)
    return allowed.select("id", "env")


@query("""SELECT event_type, user_id, value, event_type = 'view' AS local FROM (SELECT * FROM events) WHERE event_type <> 'click'""")
def scope_filter(spark, sf_dir):
    from quillgraph.operators.log import with_scope

    kind = F.when(F.col("event_type") == "view", "pipelineRun:progress").when(F.col("event_type") == "click", "facet:add").otherwise("instance:upsert")
    scoped = with_scope(Model(spark, sf_dir).table("events").withColumn("cmd_type", kind))
    return scoped.where("tier = 'M0'").select("event_type", "user_id", "value", (F.col("scope") == "device-local").alias("local"))


@query("SELECT k.id, coalesce(N.name, k.id) AS name, N.class_id FROM (SELECT DISTINCT 'bm:thing:p' || (l_partkey * 3) AS id FROM lineitem) k LEFT JOIN N ON N.uri = k.id", "N")
def resolve_names(spark, sf_dir):
    m = Model(spark, sf_dir)
    wanted = m.table("lineitem").select(F.lit("tpch").alias("map_id"), F.concat(F.lit("bm:thing:p"), (F.col("l_partkey") * 3).cast("string")).alias("id")).distinct()
    return joins.resolve_names(wanted, m).select("id", "name", "class_id")


@query("SELECT 'bm:persona:c' || o_custkey AS id, 'performs' AS predicate, 'bm:action:o' || o_orderkey AS neighbour FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def link_targets(spark, sf_dir):
    m = Model(spark, sf_dir)
    return joins.link_targets(sets.ids(m.customers.where(sets.has_tag("BUILDING"))), m.links, "performs").select("id", "predicate", "neighbour")


@query("SELECT target_uri AS id, predicate, source_uri AS neighbour FROM L JOIN part ON target_uri = 'bm:thing:p' || p_partkey WHERE p_size > 45", "L")
def link_sources(spark, sf_dir):
    m = Model(spark, sf_dir)
    return joins.link_sources(sets.ids(m.parts.where(sets.compare("size", "gt", 45))), m.links).select("id", "predicate", "neighbour")


@query("""SELECT source_uri AS id, predicate, 'outgoing' AS direction, count(*) AS n FROM L GROUP BY 1, 2
  UNION ALL SELECT target_uri, predicate, 'incoming', count(*) FROM L GROUP BY 1, 2""", "L")
def entity_link_summary(spark, sf_dir):
    return joins.link_summary(Model(spark, sf_dir)).select("id", "predicate", "direction", "n")


@query("""SELECT 'bm:persona:c' || c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <= 8""")
def flt_has_link(spark, sf_dir):
    m = Model(spark, sf_dir)
    return joins.has_link(sets.ids(m.customers), m.links, "performs", "outgoing", 0, 8).select("id", F.col("n").cast("long").alias("n"))


@query("SELECT 'bm:rel:' || o_orderkey AS id FROM orders WHERE o_custkey % 7 = 0 OR o_orderkey % 11 = 0")
def relationships_of(spark, sf_dir):
    m = Model(spark, sf_dir)
    some = m.table("customer").where("c_custkey % 7 = 0").select(uri("inst:", "c_custkey").alias("id")).union(m.table("orders").where("o_orderkey % 11 = 0").select(uri("order:", "o_orderkey")))
    return joins.relationships_of(m.relationships, some).select("id")


@query("""SELECT l.predicate, CASE WHEN l.source_uri = l.target_uri THEN 'self-link' WHEN s.uri IS NULL THEN 'source-missing' WHEN t.uri IS NULL THEN 'target-missing'
    WHEN l.predicate = 'performs' AND s.class_id <> 'Persona' THEN 'domain' WHEN l.predicate = 'performs' AND t.class_id <> 'Action' THEN 'range' END AS fault, count(*) AS n
  FROM (SELECT predicate, source_uri, target_uri FROM L UNION ALL SELECT 'performs', target_uri, source_uri FROM L WHERE predicate = 'extends'
        UNION ALL SELECT 'performs', 'bm:persona:c' || (c_custkey * 2), 'bm:action:none' FROM customer UNION ALL SELECT 'performs', 'bm:persona:c' || c_custkey, 'bm:persona:s' || 1 FROM customer) l
  LEFT JOIN N s ON s.uri = l.source_uri LEFT JOIN N t ON t.uri = l.target_uri GROUP BY 1, 2""", "N L")
def validate_links(spark, sf_dir):
    m = Model(spark, sf_dir)
    more = m._links(m.extends, F.lit("performs"), F.col("target_uri"), F.col("source_uri"))
    bad = m._links(m.table("customer"), F.lit("performs"), F.concat(F.lit("bm:persona:c"), (F.col("c_custkey") * 2).cast("string")), F.lit("bm:action:none"))
    worse = m._links(m.table("customer"), F.lit("performs"), uri("persona:c", "c_custkey"), F.lit("bm:persona:s1"))
    checked = joins.validate_links(m.links.unionByName(more).unionByName(bad).unionByName(worse), m)
    return checked.groupBy("predicate", "fault").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_uri, predicate, target_uri FROM L WHERE source_uri NOT IN (SELECT 'bm:thing:p' || p_partkey FROM part WHERE p_size % 2 = 0) AND target_uri NOT IN (SELECT 'bm:thing:p' || p_partkey FROM part WHERE p_size % 2 = 0) AND (source_uri IN (SELECT uri FROM N)) AND target_uri IN (SELECT uri FROM N)", "L N")
def prune_dangling_links(spark, sf_dir):
    m = Model(spark, sf_dir)
    left = sets.ids(m.entities.where(~((F.col("class_id") == "Thing") & sets.sure(number_of(field("size")) % 2 == 0)))).unionByName(sets.ids(m.contexts))
    # Lines repeat pairs: they are pruned as they are and then, where the last join has put a source's links, taken once.
    columns = ["source_uri", "predicate", "target_uri"]
    often = joins.prune_dangling(m.walks("reads", "writes", "stewards"), left).select(*columns).distinct()
    return joins.prune_dangling(m.performs.unionByName(m.value_streams).unionByName(m.extends), left).select(*columns).unionByName(often)


@query("""SELECT source_uri, predicate, target_uri FROM L WHERE NOT (predicate IN ('reads', 'writes') AND target_uri IN (SELECT 'bm:thing:p' || p_partkey FROM part WHERE p_size % 10 = 0))""", "L")
def prune_retyped_links(spark, sf_dir):
    m = Model(spark, sf_dir)
    changed = sets.ids(m.parts.where(sets.sure(number_of(field("size")) % 10 == 0))).withColumn("new_class", F.lit("Context"))
    return joins.prune_retyped(m.links, changed, spark).select("source_uri", "predicate", "target_uri")


@query("SELECT CAST(count(*) AS DOUBLE) AS value FROM customer WHERE c_acctbal < 0")
def agg_count(spark, sf_dir):
    return sets.aggregate(Model(spark, sf_dir).customers.where(sets.compare("acctbal", "lt", 0)), "count")


@query("""SELECT 'sum' AS op, round(sum(p_retailprice), 2) AS value FROM part UNION ALL SELECT 'avg', round(avg(p_retailprice), 2) FROM part
  UNION ALL SELECT 'min', min(p_retailprice) FROM part UNION ALL SELECT 'max', max(p_retailprice) FROM part UNION ALL SELECT 'max of text', 0.0""")
def agg_numeric(spark, sf_dir):
    parts = Model(spark, sf_dir).parts
    price = number_of(field("price"))
    wide = parts.agg(F.round(F.sum(price), 2).alias("sum"), F.round(F.avg(price), 2).alias("avg"), F.min(price).alias("min"), F.max(price).alias("max"), F.coalesce(F.max(number_of(field("brand"))), F.lit(0.0)).alias("max of text"))
    return wide.unpivot([], ["sum", "avg", "min", "max", "max of text"], "op", "value")


@query("SELECT CAST(count(DISTINCT p_brand) AS DOUBLE) AS value FROM part")
def agg_count_distinct(spark, sf_dir):
    return sets.aggregate(Model(spark, sf_dir).parts, "countDistinct", "brand")


@query("SELECT coalesce(c_mktsegment, 'unknown') AS \"group\", round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1 UNION ALL SELECT 'unknown', round(avg(s_acctbal), 4) FROM supplier")
def agg_group_by(spark, sf_dir):
    m = Model(spark, sf_dir)
    return sets.aggregate(m.customers.unionByName(m.suppliers), "avg", "acctbal", "segment").select("group", F.round("value", 4).alias("value"))


@query("SELECT C.uri AS container_uri, count(E.uri) AS n, CASE WHEN count(E.uri) < 1 THEN 'too-few' ELSE 'too-many' END AS fault FROM C LEFT JOIN E ON E.container_uri = C.uri AND E.class_id = 'Persona' GROUP BY C.uri HAVING count(E.uri) < 1 OR count(E.uri) > 60", "C E")
def facet_count_bounds(spark, sf_dir):
    return joins.facet_count_bounds(Model(spark, sf_dir), "Persona", 1, 60).select("container_uri", F.col("n").cast("long").alias("n"), "fault")


@query("SELECT lower(p_name) AS term, count(DISTINCT p_size % 5) AS n_containers, count(*) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 5) >= 2")
def shared_terms(spark, sf_dir):
    m = Model(spark, sf_dir)
    m.entities = m.parts.withColumn("container_uri", F.concat(F.lit("bm:ctx:r"), (number_of(field("size")) % 5).cast("int").cast("string")))
    return joins.shared_terms(m).select("term", "n_containers", "n")


@query("SELECT lower(p_name) AS term, 'bm:ctx:r' || (p_size % 5) AS container_uri, count(*) AS n FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 5) >= 2) GROUP BY 1, 2")
def shared_term_places(spark, sf_dir):
    m = Model(spark, sf_dir)
    m.entities = m.parts.withColumn("container_uri", F.concat(F.lit("bm:ctx:r"), (number_of(field("size")) % 5).cast("int").cast("string")))
    return joins.shared_term_places(m).select("term", "container_uri", "n")


@query("""WITH P AS (SELECT uri, coalesce(container_uri, uri) AS place, name FROM N),
  X2 AS (SELECT L.predicate, s.place AS f, t.place AS g, s.name AS sn, t.name AS tn FROM L JOIN P s ON s.uri = L.source_uri JOIN P t ON t.uri = L.target_uri WHERE s.place <> t.place AND L.predicate = 'stewards')
  SELECT DISTINCT f AS container_uri, 'out' AS way, predicate, tn AS name FROM X2 UNION ALL SELECT DISTINCT g, 'in', predicate, sn FROM X2""", "N L")
def boundary_names(spark, sf_dir):
    m = Model(spark, sf_dir)
    m.links = m.stewards
    return joins.boundary_names(m).select("container_uri", "way", "predicate", "name")


@query("SELECT E.container_uri, count(*) AS n FROM E JOIN C ON C.uri = E.container_uri WHERE C.parent_uri IS NOT NULL GROUP BY 1 HAVING count(*) > 20", "C E")
def god_contexts(spark, sf_dir):
    return joins.god_contexts(Model(spark, sf_dir)).select("container_uri", "n")


@query("""WITH P AS (SELECT uri, coalesce(container_uri, uri) AS place FROM N),
  X2 AS (SELECT L.predicate, s.place AS f, t.place AS g FROM L JOIN P s ON s.uri = L.source_uri JOIN P t ON t.uri = L.target_uri WHERE s.place <> t.place)
  SELECT f AS container_uri, 'out:' || predicate AS what, count(*) AS n FROM X2 GROUP BY 1, 2 UNION ALL SELECT g, 'in:' || predicate, count(*) FROM X2 GROUP BY 1, 2
  UNION ALL SELECT container_uri, 'facet:' || class_id, count(*) FROM E GROUP BY 1, 2""", "N L")
def boundary_table(spark, sf_dir):
    return joins.boundary_table(Model(spark, sf_dir)).select("container_uri", "what", "n")


@query("SELECT 'bm:inst:' || c_custkey AS id FROM customer ORDER BY 1700000000 + c_custkey % 977, id LIMIT 50 OFFSET 100")
def page_instances(spark, sf_dir):
    return joins.page(Model(spark, sf_dir).instances, "thing:customer", 100, 50).select("id")


@query("SELECT 'root' AS context_name, p_name AS name, 'bm:thing:p' || p_partkey AS id, p_type AS definition FROM part WHERE p_size % 3 = 2 AND trim(p_type) <> ''")
def glossary(spark, sf_dir):
    return joins.glossary(Model(spark, sf_dir)).orderBy("context_name", "name", "id")


@query("SELECT 'bm:persona:c' || c_custkey AS id FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING'")
def set_union(spark, sf_dir):
    m = Model(spark, sf_dir)
    return out(sets.union(sets.ids(m.customers.where(sets.compare("acctbal", "gt", 5000))), sets.ids(m.customers.where(sets.has_tag("BUILDING")))))


@query("SELECT 'bm:persona:c' || c_custkey AS id FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def set_intersect(spark, sf_dir):
    m = Model(spark, sf_dir)
    return out(sets.intersect(sets.ids(m.customers.where(sets.compare("acctbal", "gt", 5000))), sets.ids(m.customers.where(sets.has_tag("BUILDING")))))


@query("SELECT 'bm:persona:c' || c_custkey AS id FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'")
def set_subtract(spark, sf_dir):
    m = Model(spark, sf_dir)
    return out(sets.subtract(sets.ids(m.customers.where(sets.compare("acctbal", "gt", 5000))), sets.ids(m.customers.where(sets.has_tag("BUILDING")))))


@query("SELECT 'thing:customer' AS thing_id, 'bm:inst:' || c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'thing:supplier', 'bm:supp:' || s_suppkey, NULL FROM supplier")
def composite_union(spark, sf_dir):
    from quillgraph.sources.files import composite

    m = Model(spark, sf_dir)
    customers = m.instances.select("thing_id", "id", number_of(F.element_at("attributes", F.lit("balance"))["value"]).alias("balance"))
    suppliers = m.table("supplier").select(F.lit("thing:supplier").alias("thing_id"), uri("supp:", "s_suppkey").alias("id"))
    return composite({"thing:customer": customers, "thing:supplier": suppliers})


@query("""WITH S AS (SELECT predicate, source_uri, target_uri FROM L WHERE predicate IN ('stewards', 'performs', 'valueStream')), T(p, o, i, oc, ic) AS (VALUES ('stewards', 'is responsible for', 'responsibility of', 'Persona', 'Thing'), ('performs', 'does', 'done by', 'Persona', 'Action'), ('valueStream', 'sends value to', 'receives value from', 'Context', 'Context'))
  SELECT source_uri AS id, o AS label, target_uri AS neighbour, coalesce(N.name, target_uri) AS name FROM S JOIN T ON p = predicate JOIN N M ON M.uri = source_uri AND M.class_id = oc LEFT JOIN N ON N.uri = target_uri
  UNION ALL SELECT target_uri, i, source_uri, coalesce(N.name, source_uri) FROM S JOIN T ON p = predicate JOIN N M ON M.uri = target_uri AND M.class_id = ic LEFT JOIN N ON N.uri = source_uri""", "L N")
def link_labels(spark, sf_dir):
    """Links from both ends under their names in business, a row each."""
    m = Model(spark, sf_dir)
    m.links = m.stewards.unionByName(m.performs).unionByName(m.value_streams)
    return joins.link_lines(m).select("id", "label", "neighbour", "name")
