"""Walks, logs, versions, triples, texts, actions and streams over data that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as texts
from quillgraph.functions.json_text import field, number_of, quoted, string_of
from quillgraph.functions.vocab import RUNTIME_COMMANDS
from quillgraph.jobs.model import Model, uri
from quillgraph.jobs.queries_mapping import EV, MAPPING, records_of, responses
from quillgraph.jobs.registry import query
from quillgraph.operators import actions, graph, joins, log, mapping, quality, runtime, sets, triples, versions
from quillgraph.sources import files
from quillgraph.streaming import streams


@query("""SELECT o_orderstatus AS "group", round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1""")
def flagship(spark, sf_dir):
    """Totals by status of the orders that customers of one segment perform: base set, filter, walk, aggregate."""
    reached = sets.Query.of(Model(spark, sf_dir), "personas").where({"segment": "BUILDING"}).traverse("performs", "out", 1).entities()
    total = F.round(F.sum(number_of(field("total"))), 2)
    return reached.groupBy(string_of(field("status")).alias("group")).agg(total.alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, B AS (SELECT user_id % 50 AS customer, arg_max(upper(event_type), event_id) AS kind, count(*) AS n, round(sum(value), 2) AS amount FROM EV WHERE status = 'ok' AND value < 100 GROUP BY 1) SELECT customer, kind, n, amount FROM B""")
def etl(spark, sf_dir):
    """Responses to records, mapped, validated, reduced per key with the newest kind: the whole path of a source."""
    rows = mapping.run_mapping(records_of(Model(spark, sf_dir), MAPPING.iterate), MAPPING).where("status = 'ok'")
    fault = quality.constraint_fault(field("amount"), high=100.0)
    valid = rows.where(fault.isNull() & (number_of(field("amount")) < 100)).withColumn("event_id", F.substring("external_id", 3, 20).cast("long"))
    kind = F.max_by(string_of(field("kind")), "event_id").alias("kind")
    return valid.groupBy((F.col("user_id") % 50).alias("customer")).agg(kind, F.count(F.lit(1)).alias("n"), F.round(F.sum(number_of(field("amount"))), 2).alias("amount"))


ORDERS = mapping.Mapping(thing="thing:order", filter="$.open", identity="$.id", fields={"amount": mapping.Field("$.total"), "kind": mapping.Field('"order"')}, links={"byUser": ("thing:user", "$.user")})


@query(f"""WITH {EV}, A AS (SELECT 'events' AS source, status, value AS amount, CAST(user_id AS VARCHAR) AS u, 'ev' || event_id AS x, event_id % 4 = 0 AS old FROM EV
    UNION ALL SELECT 'orders', CASE WHEN o_orderstatus = 'F' THEN 'skipped' ELSE 'ok' END, o_totalprice, CAST(o_custkey AS VARCHAR), 'or' || o_orderkey, false FROM orders),
  V AS (SELECT *, status = 'ok' AND amount > CASE source WHEN 'events' THEN 100 ELSE 150000 END AS bad, u IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 <> 0) AS known FROM A)
  SELECT source, count(*) AS fetched, count(*) FILTER (status = 'ok') AS mapped, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (bad) AS invalid,
    count(*) FILTER (status = 'ok' AND NOT bad AND known) AS links, count(*) FILTER (status = 'ok' AND NOT bad AND NOT known) AS pending, count(*) FILTER (old OR status = 'ok' AND NOT bad) AS stored, count(*) FILTER (old AND NOT (status = 'ok' AND NOT bad)) AS untouched FROM V GROUP BY 1""")
def etl_run(spark, sf_dir):
    """The whole path of two sources: responses and order documents to records, mapped, validated, upserted into a table with
    rows of an earlier run, links resolved, and a report per source."""
    m = Model(spark, sf_dir)
    c = F.col
    events = mapping.run_mapping(records_of(m, MAPPING.iterate), MAPPING).select(F.lit("events").alias("source"), "type_uri", "external_id", "fields", "links", "status")
    document = F.to_json(F.struct(F.concat(F.lit("or"), c("o_orderkey").cast("string")).alias("id"), c("o_totalprice").alias("total"), c("o_custkey").cast("string").alias("user"), (c("o_orderstatus") != "F").alias("open")))
    orders = mapping.run_mapping(mapping.iterate(m.table("orders").select(document.alias("body")), None), ORDERS).select(F.lit("orders").alias("source"), "type_uri", "external_id", "fields", "links", "status")
    high = lambda most: quality.constraint_fault(field("amount"), high=most)
    fault = F.when(c("source") == "events", high(100.0)).otherwise(high(150000.0))
    rows = files.durable(events.unionByName(orders).withColumn("valid", (c("status") == "ok") & fault.isNull()), "mapped")  # five uses
    old = m.table("events").where("event_id % 4 = 0").select(F.lit("thing:event").alias("type_uri"), F.concat(F.lit("ev"), c("event_id").cast("string")).alias("external_id"), F.create_map().cast("map<string,string>").alias("fields"))
    table = mapping.upsert(old, rows.where("valid").select("type_uri", "external_id", "fields"), ["external_id"])
    users = m.table("customer").where("c_custkey % 3 != 0").select(F.lit("thing:user").alias("type_uri"), c("c_custkey").cast("string").alias("external_id"), uri("user:", "c_custkey").alias("uri"))
    found, pending = joins.resolve_links(mapping.mapped_links(rows.where("valid")), users)
    report = rows.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), *[F.count_if(c("status") == s).alias(n) for s, n in (("ok", "mapped"), ("skipped", "skipped"), ("error", "errors"))], F.count_if((c("status") == "ok") & ~c("valid")).alias("invalid"))
    named = F.when(c("type_uri") == "thing:event", "events").otherwise("orders").alias("source")
    counted = lambda df, n: df.groupBy(named).agg(F.count(F.lit(1)).alias(n))
    for part in (counted(found, "links"), counted(pending, "pending"), counted(table, "stored"), counted(table.where(F.size("fields") == 0), "untouched")):
        report = report.join(part, "source", "left")
    return report.na.fill(0, ["links", "pending", "stored", "untouched"])


# Walks.
@query("""WITH S0 AS (SELECT 'bm:persona:s' || s_suppkey AS id FROM supplier WHERE s_suppkey < 3),
  W AS (SELECT id, 0 AS d FROM S0 UNION SELECT L.target_uri, W.d + 1 FROM W JOIN L ON L.source_uri = W.id WHERE W.d < 3)
  SELECT id, CAST(min(d) AS INTEGER) AS depth FROM W WHERE id NOT IN (SELECT id FROM S0) GROUP BY id""", "L", True)
def traverse(spark, sf_dir):
    m = Model(spark, sf_dir)
    start = sets.ids(m.suppliers.where("ord < 3"))
    return graph.traverse(start, m.walks(), "*", "out", 3).select("id", "depth")


PLACES = """P AS (SELECT 'bm:ctx:p' || p_partkey AS uri, CASE WHEN p_partkey >= 10 THEN 'bm:ctx:p' || (p_partkey // 10) END AS parent_uri, p_size FROM part)"""


def places(m: Model):
    """Every part as a container inside the one with a tenth of its key."""
    up = F.when(F.col("p_partkey") >= 10, F.concat(F.lit("bm:ctx:p"), F.expr("p_partkey div 10").cast("string")))
    return m.table("part").select(F.lit("tpch").alias("map_id"), uri("ctx:p", "p_partkey").alias("uri"), up.alias("parent_uri"), "p_size")


def chains(m: Model):
    """Every part as a container inside the one before it, two hundred deep."""
    part = m.table("part")
    there = part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.lit(True).alias("_up"))
    up = F.when((F.col("p_partkey") % 200 > 0) & F.col("_up"), F.concat(F.lit("bm:ctx:p"), (F.col("p_partkey") - 1).cast("string")))
    return part.join(there, "p_partkey", "left").select(F.lit("tpch").alias("map_id"), uri("ctx:p", "p_partkey").alias("uri"), up.alias("parent_uri"), "p_size")


@query(f"""WITH {PLACES}, T AS (SELECT uri AS node, uri AS ancestor, 0 AS depth FROM P UNION ALL SELECT T.node, P.parent_uri, T.depth + 1 FROM T JOIN P ON P.uri = T.ancestor WHERE P.parent_uri IS NOT NULL)
  SELECT node, ancestor, CAST(depth AS INTEGER) AS depth FROM T""", recursive=True)
def context_tree(spark, sf_dir):
    return graph.context_tree(places(Model(spark, sf_dir)))


@query(f"WITH {PLACES} SELECT uri AS id FROM P WHERE p_size % 7 <> 0 AND parent_uri IN (SELECT uri FROM P WHERE p_size % 7 = 0)")
def orphan_contexts(spark, sf_dir):
    return joins.orphan_contexts(places(Model(spark, sf_dir)).where("p_size % 7 != 0")).select(F.col("uri").alias("id"))


@query("""WITH B AS (SELECT source_uri AS a, target_uri AS b FROM L WHERE predicate IN ('extends', 'stewards') UNION SELECT target_uri, source_uri FROM L WHERE predicate IN ('extends', 'stewards')), S0 AS (SELECT 'bm:thing:p77' AS id),
  W AS (SELECT id, 0 AS d FROM S0 UNION SELECT B.b, W.d + 1 FROM W JOIN B ON B.a = W.id WHERE W.d < 2)
  SELECT W.id, CAST(min(W.d) AS INTEGER) AS depth, any_value(N.container_uri) AS container_uri FROM W LEFT JOIN N ON N.uri = W.id WHERE W.id NOT IN (SELECT id FROM S0) GROUP BY W.id""", "L N", True)
def impact(spark, sf_dir):
    m = Model(spark, sf_dir)
    start = sets.ids(m.parts.where("ord = 77"))
    return graph.impact(start, m.walks("extends", "stewards"), joins.named(m), 2).select("id", "depth", "container_uri")


INHERIT = """A AS (SELECT 'bm:thing:p' || p_partkey AS thing, 'brand:' || p_brand AS attribute FROM part UNION ALL SELECT 'bm:thing:p' || p_partkey, 'size' FROM part WHERE p_size > 25),
  W AS (SELECT thing AS node, thing AS anc, 0 AS d FROM (SELECT DISTINCT thing FROM A) UNION SELECT W.node, X.target_uri, W.d + 1 FROM W JOIN X ON X.source_uri = W.anc WHERE W.d < 8)"""


@query(f"""WITH {INHERIT} SELECT node AS thing, attribute, arg_min(anc, d) AS owner, CAST(min(d) AS INTEGER) AS depth FROM W JOIN A ON A.thing = W.anc GROUP BY 1, 2""", "X", True)
def inherit_attributes(spark, sf_dir):
    m = Model(spark, sf_dir)
    things = m.parts.select(F.col("uri").alias("thing"), F.concat(F.lit("brand:"), string_of(field("brand"))).alias("attribute")).union(m.parts.where(number_of(field("size")) > 25).select("uri", F.lit("size")))
    first = m.extends.select(F.col("source_uri").alias("node"), F.col("target_uri").alias("up"))
    return graph.inherit_attributes(first, things)


@query("""WITH W AS (SELECT source_uri AS node, target_uri AS ancestor FROM X UNION SELECT W.node, X.target_uri FROM W JOIN X ON X.source_uri = W.ancestor), R AS (SELECT node FROM W WHERE node = ancestor)
  SELECT node, ancestor, node IN (SELECT node FROM R) OR node IN (SELECT W.node FROM W JOIN R ON R.node = W.ancestor) AS circular FROM W WHERE node <> ancestor""", "X", True)
def inheritance_chains(spark, sf_dir):
    first = Model(spark, sf_dir).extends.select(F.col("source_uri").alias("node"), F.col("target_uri").alias("up"))
    return graph.inheritance_chains(first).select("node", "ancestor", "circular")


@query("SELECT source_uri AS id, 'parent' AS side, target_uri AS neighbour FROM X UNION ALL SELECT target_uri, 'child', source_uri FROM X", "X")
def extends_neighbours(spark, sf_dir):
    return graph.extends_neighbours(Model(spark, sf_dir).extends)


@query("SELECT source_uri AS id FROM X WHERE EXISTS (SELECT 1 FROM X y WHERE y.source_uri = X.target_uri AND y.target_uri = X.source_uri)", "X")
def circular_extends(spark, sf_dir):
    return graph.circular_extends(Model(spark, sf_dir).extends.select(F.col("source_uri").alias("src"), F.col("target_uri").alias("dst")))


@query("""WITH F AS (SELECT l_partkey AS a, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS b FROM lineitem GROUP BY 1), W AS (SELECT a, b FROM F UNION SELECT W.a, F.b FROM W JOIN F ON F.a = W.b)
  SELECT DISTINCT 'bm:thing:p' || a AS id FROM W WHERE a = b""", recursive=True)
def circular_extends_last(spark, sf_dir):
    """Parts that extend the part with the number of their supplier, line after line: the last one counts; cycles of any length with long tails."""
    lines = Model(spark, sf_dir).table("lineitem").select(uri("thing:p", "l_partkey").alias("src"), uri("thing:p", "l_suppkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order"))
    return graph.circular_extends(lines, "order")


@query("""WITH P AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 200 > 0 AND p_partkey - 1 IN (SELECT p_partkey FROM part) THEN p_partkey - 1 END AS up FROM part), T AS (SELECT k AS node, k AS ancestor, 0 AS depth FROM P UNION ALL SELECT T.node, P.up, T.depth + 1 FROM T JOIN P ON P.k = T.ancestor WHERE P.up IS NOT NULL)
  SELECT 'bm:ctx:p' || node AS node, 'bm:ctx:p' || ancestor AS ancestor, CAST(depth AS INTEGER) AS depth FROM T""", recursive=True)
def context_tree_deep(spark, sf_dir):
    """Parts as containers in chains of two hundred."""
    return graph.context_tree(chains(Model(spark, sf_dir)))


@query("""WITH D AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 10 < 6 UNION SELECT s_suppkey, s_suppkey - 3 FROM supplier WHERE s_suppkey % 10 = 5 UNION SELECT s_suppkey, s_suppkey + 10 FROM supplier WHERE s_suppkey % 10 IN (0, 3)
    UNION SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 10 = 8),
  W AS (SELECT a, b FROM D UNION SELECT W.a, D.b FROM W JOIN D ON D.a = W.b) SELECT DISTINCT a AS id FROM W WHERE a = b""", recursive=True)
def value_stream_cycles(spark, sf_dir):
    """Suppliers in chains over tens, with a ring of four in every ten and a loop of one."""
    s, k = Model(spark, sf_dir).table("supplier"), F.col("s_suppkey")
    steps = F.concat(*[F.when(test, F.array(k + step)).otherwise(F.array().cast("array<bigint>")) for test, step in ((k % 10 < 6, 1), (k % 10 == 5, -3), ((k % 10).isin(0, 3), 10), (k % 10 == 8, 0))])
    return graph.cyclic_nodes(s.select(k.alias("src"), F.explode(steps).alias("dst")))


@query("""WITH U AS (SELECT c_custkey AS u, c_custkey % 40 AS p FROM customer), W AS (SELECT u, p FROM U UNION SELECT u, p // 3 FROM W WHERE p > 0),
  G AS (SELECT 13 AS p, 2 AS r UNION ALL SELECT 4, 3 UNION ALL SELECT 30, 2)
  SELECT W.u AS "user", CASE coalesce(max(r), 1) WHEN 1 THEN 'viewer' WHEN 2 THEN 'editor' ELSE 'owner' END AS capability FROM W LEFT JOIN G ON G.p = W.p GROUP BY 1""", recursive=True)
def grants(spark, sf_dir):
    users = Model(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("user"), (F.col("c_custkey") % 40).alias("persona"))
    personas = users.where("persona > 0").select(F.col("persona").alias("node"), F.expr("persona div 3").alias("up")).distinct()
    granted = spark.sql("SELECT * FROM VALUES (13L, 'editor'), (4L, 'owner'), (30L, 'editor') AS t(persona, capability)")
    return graph.grants(users, personas, granted)


# Logs.
@query("SELECT event_id AS sequence FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id % 1000 = 0)")
def log_tail(spark, sf_dir):
    commits = Model(spark, sf_dir).commits
    return log.tail(commits, commits.where("sequence % 1000 = 0").select("map_id", "branch_id", "sequence")).select("sequence")


@query("SELECT event_id AS sequence, CASE WHEN event_type = 'signup' THEN sha256('bm:commit:' || event_id || '|0') ELSE 'u' || user_id END AS uri FROM events")
def stable_ids(spark, sf_dir):
    rows = Model(spark, sf_dir).table("events").select(F.col("event_id").alias("sequence"), uri("commit:", "event_id").alias("id"), F.lit(0).alias("position"), F.when(F.col("event_type") == "signup", "facet:add").otherwise("facet:update").alias("cmd_type"), F.when(F.col("event_type") != "signup", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("uri"))
    return log.stable_ids(rows).select("sequence", "uri")


JUDGED = """J AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'update' AND class_id = 'Thing' OR kind = 'upsert' AND class_id = 'Measure' THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'upsert', false) AS alive FROM CMD),
  R AS (SELECT *, CASE WHEN class_id IS NULL THEN 'unknown-type' WHEN class_id = 'Port' THEN 'not-instantiable' WHEN class_id = 'Measure' AND kind <> 'upsert' THEN 'immutable' WHEN kind <> 'upsert' AND NOT alive THEN 'absent' END AS reason FROM J)"""


@query("""WITH A AS (SELECT * FROM CMD WHERE class_id = 'Thing' OR class_id = 'Measure' AND kind = 'upsert'),
  T AS (SELECT user_id, max(sequence) FILTER (kind = 'upsert') AS up, max(sequence) FILTER (kind = 'delete') AS del FROM A GROUP BY 1),
  B AS (SELECT T.user_id, T.up, A.ts FROM T JOIN A ON A.sequence = T.up WHERE T.up > coalesce(T.del, -1)),
  U AS (SELECT B.user_id, B.ts AS created_at, arg_max(A.value, A.sequence) AS value, arg_max(A.event_type, A.sequence) AS event_type, arg_max(A.ts, A.sequence) AS ts FROM B JOIN A ON A.user_id = B.user_id AND A.kind <> 'delete' AND A.sequence >= B.up GROUP BY ALL)
  SELECT 'bm:user:' || user_id AS uri, CASE WHEN event_type IN ('signup', 'purchase') THEN value END AS value, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS event,
    CASE WHEN event_type = 'view' THEN value END AS viewed, CASE WHEN event_type = 'click' THEN value END AS clicked, created_at, ts AS updated_at FROM U""", "CMD")
def m0_replay(spark, sf_dir):
    rows = log.replay(Model(spark, sf_dir).commits)
    at = lambda n: F.element_at("data", F.lit(n))
    return rows.select("uri", number_of(at("value")).alias("value"), string_of(at("event")).alias("event"), number_of(at("viewed")).alias("viewed"), number_of(at("clicked")).alias("clicked"), "created_at", "updated_at")


@query(f"WITH {JUDGED} SELECT sequence, reason FROM R WHERE reason IS NOT NULL", "CMD")
def rejected_commands(spark, sf_dir):
    return log.rejected(Model(spark, sf_dir).commits).select("sequence", "reason")


@query(f"WITH {JUDGED} SELECT sequence, 'bm:user:' || user_id AS uri, CASE kind WHEN 'upsert' THEN 'InstanceUpserted' WHEN 'update' THEN 'InstanceUpdated' ELSE 'InstanceDeleted' END AS event FROM R WHERE reason IS NULL", "CMD")
def m0_domain_events(spark, sf_dir):
    return log.domain_events(Model(spark, sf_dir).commits).select("sequence", "uri", "event")


@query(f"""WITH {JUDGED}, P AS (SELECT * FROM R WHERE reason IS NULL),
  Q AS (SELECT *, last_value(CASE WHEN kind <> 'update' THEN kind END IGNORE NULLS) OVER w AS turn_kind, last_value(CASE WHEN kind <> 'delete' THEN value END IGNORE NULLS) OVER w AS v,
    last_value(CASE WHEN kind <> 'delete' THEN event_type END IGNORE NULLS) OVER w AS e FROM P WINDOW w AS (PARTITION BY user_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT sequence, CASE WHEN kind = 'update' THEN 'instance:update' WHEN turn_kind = 'upsert' THEN 'instance:upsert' ELSE 'instance:delete' END AS inverse,
    CASE WHEN turn_kind = 'upsert' AND e IN ('signup', 'purchase') THEN v END AS value, CASE WHEN turn_kind = 'upsert' AND e IN ('signup', 'purchase') THEN e END AS event,
    CASE WHEN turn_kind = 'upsert' AND e = 'view' THEN v END AS viewed, CASE WHEN turn_kind = 'upsert' AND e = 'click' THEN v END AS clicked FROM Q""", "CMD")
def m0_inverse(spark, sf_dir):
    rows = log.inverse(Model(spark, sf_dir).commits)
    at = lambda n: F.element_at("data", F.lit(n))
    return rows.select("sequence", "inverse", number_of(at("value")).alias("value"), string_of(at("event")).alias("event"), number_of(at("viewed")).alias("viewed"), number_of(at("clicked")).alias("clicked"))


#: Events as commands of all runtime records: a user is one record, of the kind that the id's rest by 8 names; what an event does
#: to it follows from its type. Some opening commands have no id, some commands are unknown.
RUNTIME = {
    0: ("instance", {"signup": "upsert", "purchase": "update", "view": "link", "click": "unlink", "error": "delete"}),
    1: ("pipelineRun", {"signup": "start", "view": "progress", "click": "progress", "purchase": "complete", "error": "cancel"}),
    2: ("retry", {"signup": "enqueue", "purchase": "resolve", "view": "resolve", "click": "drop", "error": "drop"}),
    3: ("suppression", {"signup": "add", "purchase": "lift", "view": "lift", "click": "lift", "error": "lift"}),
    4: ("replayPoint", {"signup": "create", "purchase": "complete", "view": "complete", "click": "abort", "error": "abort"}),
    5: ("deployment", {"signup": "record", "view": "update", "click": "update", "purchase": "retract", "error": "retract"}),
    6: ("simRun", {"signup": "start", "view": "snapshot", "click": "snapshot", "purchase": "complete", "error": "discard"}),
    7: ("writebackQueue", {"signup": "enqueue", "view": "fail", "click": "fail", "purchase": "ack", "error": "drop"}),
}


def runtime_log(m: Model):
    """sequence, ts, cmd_type, type_uri, class_id, uri, changes."""
    c = F.col
    names = {f"{k}{event}": f"{family}:{verb}" for k, (family, verbs) in RUNTIME.items() for event, verb in verbs.items()}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.concat((c("user_id") % 8).cast("string"), c("event_type")))
    rows = m.table("events").withColumn("cmd_type", F.when(c("event_id") % 103 == 0, "instance:rename").otherwise(kind))
    number = c("event_id").cast("string")
    signup, family, event = c("event_type") == "signup", c("user_id") % 8, c("event_type")
    value = {
        "status": F.when(signup, F.lit('"new"')).when((family == 1) & (event == "purchase"), F.when(c("event_id") % 2 == 0, '"completed"').otherwise('"failed"')),
        "amount": F.when(signup, c("value").cast("string")),
        "attemptCount": F.when(signup & (family == 7), (c("event_id") % 3).cast("string")),
        "data": F.when((family == 0) & event.isin("signup", "purchase"), F.concat(F.lit('{"n":'), number, F.lit("}"))),
        "recordsProcessed": F.when((family == 1) & event.isin("view", "click"), number),
        "recordsFailed": F.when((family == 1) & (event == "view"), (c("event_id") % 7).cast("string")),
        "error": F.when((family == 1) & (event == "purchase") & (c("event_id") % 2 == 1), F.lit('"lost"')),
        "target": F.when((family == 5) & (event == "view"), quoted(number)),
        "environment": F.when((family == 5) & event.isin("signup", "click"), quoted(F.concat(F.lit("e"), number))),
        "snapshotUri": F.when((family == 6) & event.isin("view", "click"), quoted(number)),
        "lastError": F.when((family == 7) & event.isin("view", "click"), quoted(number)),
        "predicate": F.when((family == 0) & event.isin("view", "click"), F.lit('"knows"')),
    }
    changes = F.map_filter(F.create_map(*[x for name, v in value.items() for x in (F.lit(name), v)]), lambda _, v: v.isNotNull())
    owner = F.when(~(signup & (c("event_id") % 101 == 0)), F.concat(F.lit("rt:"), c("user_id").cast("string")))
    class_id = F.when(family == 0, F.when(c("user_id") % 5 == 0, "Event").when(c("user_id") % 5 == 1, "Port").when(c("user_id") % 5 == 2, F.lit(None)).otherwise("Thing"))
    return rows.select(c("event_id").alias("sequence"), "ts", "cmd_type", F.when(family == 0, "bm:thing:rt").alias("type_uri"), class_id.alias("class_id"), owner.alias("uri"), changes.alias("changes"))


RUNTIME_CTES = """T(cmd, turn, event, status, stamp, inverse) AS (VALUES """ + ", ".join(
    "('{}', '{}', {}, {}, {}, '{}')".format(command, spec["turn"], *[f"'{spec[p]}'" if p in spec else "NULL" for p in ("event", "status", "stamp")], spec["inverse"]) for command, spec in RUNTIME_COMMANDS.items()
) + """), V(fam, event_type, cmd) AS (VALUES """ + ", ".join(f"({k}, '{event}', '{family}:{verb}')" for k, (family, verbs) in RUNTIME.items() for event, verb in verbs.items()) + """),
  RL AS (SELECT event_id AS sequence, ts, user_id, user_id % 8 AS fam, V.event_type, value, CASE WHEN event_id % 103 = 0 THEN 'instance:rename' ELSE cmd END AS cmd,
      CASE WHEN NOT (V.event_type = 'signup' AND event_id % 101 = 0) THEN 'rt:' || user_id END AS uri,
      CASE WHEN user_id % 8 = 0 THEN CASE user_id % 5 WHEN 0 THEN 'Event' WHEN 1 THEN 'Port' WHEN 2 THEN NULL ELSE 'Thing' END END AS class_id
    FROM events JOIN V ON V.fam = user_id % 8 AND V.event_type = events.event_type),
  RS AS (SELECT RL.*, turn, event, status, stamp, inverse, CASE WHEN turn IS NULL THEN 'unknown-command' WHEN turn = 'open' AND fam = 0 AND class_id IS NULL THEN 'unknown-type' WHEN turn = 'open' AND class_id = 'Port' THEN 'not-instantiable'
      WHEN turn = 'open' AND uri IS NULL THEN 'no-uri' WHEN turn IN ('set', 'delete') AND class_id = 'Event' THEN 'immutable' END AS unfit FROM RL LEFT JOIN T USING (cmd)),
  RW AS (SELECT *, max(CASE WHEN unfit IS NULL AND turn IN ('open', 'delete') THEN sequence END) OVER w AS since,
      last_value(CASE WHEN unfit IS NULL AND turn IN ('open', 'delete') THEN turn END IGNORE NULLS) OVER w AS was FROM RS WINDOW w AS (PARTITION BY user_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  RJ AS (SELECT *, coalesce(unfit, CASE WHEN turn IN ('set', 'status', 'delete') AND was IS DISTINCT FROM 'open' THEN 'absent' END) AS reason FROM RW)"""


@query(f"WITH {RUNTIME_CTES} SELECT sequence, cmd AS cmd_type, uri, reason FROM RJ WHERE reason IS NOT NULL")
def runtime_rejections(spark, sf_dir):
    """Commands of all kinds that are rejected, with the reason."""
    return runtime.rejections(runtime_log(Model(spark, sf_dir)))


@query(f"WITH {RUNTIME_CTES} SELECT sequence, uri, event FROM RJ WHERE reason IS NULL AND event IS NOT NULL")
def runtime_events(spark, sf_dir):
    """Events of all accepted commands."""
    return runtime.events(runtime_log(Model(spark, sf_dir))).select("sequence", "uri", "event")


@query(f"""WITH {RUNTIME_CTES},
  A AS (SELECT *, CASE WHEN turn = 'set' OR turn = 'status' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamped,
    CASE WHEN turn = 'open' THEN 'new' WHEN turn = 'status' THEN status WHEN cmd = 'pipelineRun:complete' THEN CASE WHEN sequence % 2 = 0 THEN 'completed' ELSE 'failed' END END AS s,
    CASE WHEN fam = 0 AND event_type IN ('signup', 'purchase') THEN '{{"n":' || sequence || '}}' END AS d, CASE WHEN fam = 1 AND event_type IN ('view', 'click') THEN sequence END AS p, CASE WHEN fam = 1 AND event_type = 'view' THEN sequence % 7 END AS q,
    CASE WHEN fam = 5 AND event_type = 'view' THEN CAST(sequence AS VARCHAR) END AS t, CASE WHEN fam = 5 AND event_type IN ('signup', 'click') THEN 'e' || sequence END AS e,
    CASE WHEN fam = 6 AND event_type IN ('view', 'click') THEN CAST(sequence AS VARCHAR) END AS n, CASE WHEN cmd = 'writebackQueue:fail' THEN CAST(sequence AS VARCHAR) END AS l FROM RJ WHERE reason IS NULL),
  F AS (SELECT *, last_value(CASE WHEN turn <> 'open' THEN s END IGNORE NULLS) OVER w AS s1, last_value(CASE WHEN turn <> 'open' THEN d END IGNORE NULLS) OVER w AS d1, last_value(p IGNORE NULLS) OVER w AS p1, last_value(q IGNORE NULLS) OVER w AS q1,
    last_value(t IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN turn <> 'open' THEN e END IGNORE NULLS) OVER w AS e1, last_value(n IGNORE NULLS) OVER w AS n1, last_value(l IGNORE NULLS) OVER w AS l1, last_value(CASE WHEN stamp = 'completedAt' THEN stamped END IGNORE NULLS) OVER w AS c1,
    last_value(CASE WHEN stamp = 'updatedAt' THEN stamped END IGNORE NULLS) OVER w AS u1, count(CASE WHEN cmd = 'writebackQueue:fail' THEN 1 END) OVER w AS fails
    FROM A WINDOW w AS (PARTITION BY user_id, since ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  G AS (SELECT F.*, o.value AS amount, o.sequence % 3 + fails AS attempts, coalesce(s1, CASE WHEN was = 'open' THEN 'new' END) AS s2, coalesce(d1, CASE WHEN F.fam = 0 AND was = 'open' THEN '{{"n":' || F.since || '}}' END) AS d2, coalesce(e1, CASE WHEN F.fam = 5 AND was = 'open' THEN 'e' || F.since END) AS e2,
    F.turn IN ('status', 'delete') OR F.cmd = 'instance:upsert' AND was = 'open' AS whole FROM F LEFT JOIN RL o ON o.sequence = F.since AND was = 'open')
  SELECT sequence, uri, CASE WHEN cmd = 'instance:upsert' AND was = 'open' THEN cmd ELSE inverse END AS inverse,
    CASE WHEN whole THEN s2 WHEN cmd = 'pipelineRun:complete' THEN CASE WHEN s2 IN ('completed', 'failed') THEN s2 ELSE 'completed' END END AS status, CASE WHEN whole THEN amount END AS amount, CASE WHEN whole AND fam = 7 THEN attempts END AS attempts,
    CASE WHEN whole OR cmd = 'instance:update' THEN d2 END AS data, CASE WHEN whole AND fam = 1 THEN p1 WHEN cmd = 'pipelineRun:progress' THEN coalesce(p1, 0) END AS processed, CASE WHEN whole AND fam = 1 THEN q1 WHEN cmd = 'pipelineRun:progress' THEN coalesce(q1, 0) END AS failed,
    CASE WHEN whole OR t IS NOT NULL THEN t1 END AS target, CASE WHEN whole OR cmd = 'deployment:update' AND e IS NOT NULL THEN e2 END AS environment, CASE WHEN whole THEN n1 WHEN cmd = 'simRun:snapshot' THEN coalesce(n1, '') END AS snapshot, CASE WHEN whole THEN l1 END AS last_error,
    CASE WHEN whole THEN c1 END AS completed_at, CASE WHEN whole THEN u1 END AS updated_at, CASE WHEN turn = 'free' THEN 'knows' END AS predicate FROM G""")
def runtime_inverses(spark, sf_dir):
    """The command that undoes each accepted one, of all kinds, with the fields it brings back."""
    rows = runtime.inverses(runtime_log(Model(spark, sf_dir)))
    at = lambda n: F.element_at("changes", F.lit(n))
    texts_of = {"status": "status", "target": "target", "environment": "environment", "snapshot": "snapshotUri", "last_error": "lastError", "completed_at": "completedAt", "updated_at": "updatedAt", "predicate": "predicate"}
    numbers = {"attempts": "attemptCount", "processed": "recordsProcessed", "failed": "recordsFailed"}
    return rows.select("sequence", "uri", "inverse", at("amount").cast("double").alias("amount"), at("data").alias("data"), *[string_of(at(f)).alias(n) for n, f in texts_of.items()], *[at(f).cast("long").alias(n) for n, f in numbers.items()])


def operations(m: Model, opening: str, done: str, gone: str, counting: str | None):
    """Events as operational commands: signups open, purchases end well, errors drop, views count."""
    kinds = {"signup": opening, "purchase": done, "error": gone, "view": counting or "other"}
    kind = F.coalesce(*[F.when(F.col("event_type") == e, k) for e, k in kinds.items()], F.lit("other"))
    return m.table("events").select(F.concat(F.lit("op:"), F.col("user_id").cast("string")).alias("uri"), kind.alias("cmd_type"), F.col("event_id").alias("sequence"), "ts")


OPS = """OPEN AS (SELECT user_id, max(event_id) AS f, arg_max(ts, event_id) AS opened_at FROM events WHERE event_type = 'signup' GROUP BY 1),
  OPS AS (SELECT OPEN.user_id, opened_at, arg_max(event_type, event_id) FILTER (event_type IN ('signup', 'purchase', 'error')) AS last, max(ts) FILTER (event_type <> 'click') AS changed_at, count(*) FILTER (event_type = 'view') AS attempts
    FROM OPEN JOIN events e ON e.user_id = OPEN.user_id AND e.event_id >= f GROUP BY 1, 2)"""


@query(f"WITH {OPS} SELECT 'op:' || user_id AS uri, CASE last WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'acked' ELSE 'dropped' END AS status, opened_at, changed_at, attempts FROM OPS")
def ops_replay(spark, sf_dir):
    rows = operations(Model(spark, sf_dir), "writebackQueue:enqueue", "writebackQueue:ack", "writebackQueue:drop", "writebackQueue:fail")
    return log.operations(rows, "writebackQueue:enqueue", {"writebackQueue:ack": "acked", "writebackQueue:drop": "dropped"}, "writebackQueue:fail")


@query(f"""WITH {OPS} SELECT 'pipe:' || (user_id % 7) AS pipeline, max(changed_at) FILTER (last = 'purchase') AS last_sync, count(*) FILTER (last = 'signup') AS pending, count(*) FILTER (last = 'signup') AS retries, bool_or(last = 'signup') AS suppressed FROM OPS GROUP BY 1""")
def pipeline_health(spark, sf_dir):
    m = Model(spark, sf_dir)
    named = lambda df: df.withColumn("pipeline", F.concat(F.lit("pipe:"), (F.substring("uri", 4, 20).cast("long") % 7).cast("string")))
    state = lambda kind, done: named(log.operations(operations(m, f"{kind}:open", f"{kind}:done", f"{kind}:gone", f"{kind}:note"), f"{kind}:open", {f"{kind}:done": done, f"{kind}:gone": "dropped"}, f"{kind}:note"))
    return log.pipeline_health(state("pipelineRun", "completed"), state("writebackQueue", "acked"), state("retry", "resolved"), state("suppression", "lifted"))


# Versions. base: customers; ours: segment changed where the key divides by 5, without those that divide by 11; theirs:
# balance changed where it divides by 5 or 7, segment where it divides by 35, without those that divide by 13; both add.
def snapshot(m: Model, side: str):
    c = F.col("c_custkey")
    rows = m.table("customer")
    segment, balance, key = F.col("c_mktsegment"), F.col("c_acctbal"), c
    if side == "ours":
        rows, segment = rows.where("c_custkey % 11 != 0"), F.when(c % 5 == 0, "OURS").otherwise(segment)
        rows = rows.withColumn("key", c).unionByName(m.table("customer").where("c_custkey % 100 = 1").withColumn("key", c + 10_000_000))
        key = F.col("key")
    if side == "theirs":
        rows, segment = rows.where("c_custkey % 13 != 0"), F.when(c % 35 == 0, "THEIRS").otherwise(segment)
        rows = rows.withColumn("key", c).unionByName(m.table("customer").where("c_custkey % 100 = 2").withColumn("key", c + 10_000_000))
        key, balance = F.col("key"), F.when((c % 5 == 0) | (c % 7 == 0), balance + 1).otherwise(balance)
    fields = F.create_map(F.lit("segment"), quoted(segment), F.lit("balance"), F.round(balance, 2).cast("string"))
    return rows.select(F.lit("facet").alias("kind"), F.concat(F.lit("c"), key.cast("string")).alias("uri"), uri("ctx:n", "c_nationkey").alias("container_uri"), F.lit("Persona").alias("class_id"), F.col("c_name").alias("name"), fields.alias("fields"))


SIDES = """B AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal FROM customer),
  O AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'OURS' ELSE seg END AS seg, bal FROM B WHERE k % 11 <> 0 UNION ALL SELECT k + 10000000, CASE WHEN k % 5 = 0 THEN 'OURS' ELSE seg END, bal FROM B WHERE k % 100 = 1),
  T AS (SELECT k, CASE WHEN k % 35 = 0 THEN 'THEIRS' ELSE seg END AS seg, round(CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN bal + 1 ELSE bal END, 2) AS bal FROM B WHERE k % 13 <> 0
    UNION ALL SELECT k + 10000000, CASE WHEN k % 35 = 0 THEN 'THEIRS' ELSE seg END, round(CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN bal + 1 ELSE bal END, 2) FROM B WHERE k % 100 = 2),
  K AS (SELECT coalesce(B.k, O.k, T.k) AS k, B.k IS NOT NULL AS b, O.k IS NOT NULL AS o, T.k IS NOT NULL AS t, B.seg AS bs, O.seg AS os, T.seg AS ts, B.bal AS bb, O.bal AS ob, T.bal AS tb FROM B FULL JOIN O ON O.k = B.k FULL JOIN T ON T.k = coalesce(B.k, O.k)),
  M AS (SELECT *, CASE WHEN NOT o AND NOT t THEN 'removed' WHEN o AND t AND os = ts AND ob = tb THEN CASE WHEN b AND os = bs AND ob = bb THEN 'keep' ELSE 'ours' END
      WHEN (b AND t AND ts = bs AND tb = bb) OR (NOT b AND NOT t) THEN CASE WHEN o THEN 'ours' ELSE 'removed' END WHEN (b AND o AND os = bs AND ob = bb) OR (NOT b AND NOT o) THEN CASE WHEN t THEN 'theirs' ELSE 'removed' END
      WHEN b AND o AND t AND NOT (os <> bs AND ts <> bs AND os <> ts) AND NOT (ob <> bb AND tb <> bb AND ob <> tb) THEN 'merged' ELSE 'conflict' END AS outcome FROM K)"""


@query(f"WITH {SIDES} SELECT 'c' || T.k AS uri, concat_ws(',', CASE WHEN T.bal <> B.bal THEN 'balance' END, CASE WHEN T.seg <> B.seg THEN 'segment' END) AS changed FROM T JOIN B ON B.k = T.k WHERE T.seg <> B.seg OR T.bal <> B.bal")
def diff_fields(spark, sf_dir):
    m = Model(spark, sf_dir)
    both = versions.whole(snapshot(m, "base")).join(versions.whole(snapshot(m, "theirs")).withColumnRenamed("row", "other"), ["kind", "uri"])
    names = versions.changed_fields(F.col("row"), F.col("other"))
    return both.select("uri", F.array_join(names, ",").alias("changed")).where("changed != ''")


DIFF = """SELECT 'c' || coalesce(B.k, T.k) AS uri, CASE WHEN B.k IS NULL THEN 'added' WHEN T.k IS NULL THEN 'removed' ELSE 'modified' END AS change_type FROM B FULL JOIN T ON T.k = B.k WHERE B.k IS NULL OR T.k IS NULL OR T.seg <> B.seg OR T.bal <> B.bal"""


@query(f"WITH {SIDES} {DIFF}")
def diff_models(spark, sf_dir):
    m = Model(spark, sf_dir)
    return versions.diff(snapshot(m, "base"), snapshot(m, "theirs")).select("uri", "change_type")


def merged(m: Model):
    return versions.merge(snapshot(m, "base"), snapshot(m, "ours"), snapshot(m, "theirs"))


ROW = "CASE WHEN outcome = 'removed' THEN NULL WHEN outcome = 'theirs' THEN ts WHEN outcome = 'merged' AND ts <> bs THEN ts ELSE os END AS segment, CASE WHEN outcome = 'removed' THEN NULL WHEN outcome = 'theirs' THEN tb WHEN outcome = 'merged' AND tb <> bb THEN tb ELSE ob END AS balance"


@query(f"WITH {SIDES} SELECT 'c' || k AS uri, outcome, {ROW} FROM M")
def merge_models(spark, sf_dir):
    return merged(Model(spark, sf_dir)).select("uri", "outcome", string_of(F.element_at("row", "segment")).alias("segment"), number_of(F.element_at("row", "balance")).alias("balance"))


@query("""SELECT 'l' || p_partkey AS uri FROM part WHERE p_size % 7 <> 0 AND p_size % 5 <> 0 AND p_partkey >= 10 AND p_partkey // 10 IN (SELECT p_partkey FROM part WHERE p_size % 7 <> 0 AND p_size % 5 <> 0)""")
def merge_links(spark, sf_dir):
    """Parts and links between them; we remove some parts, they others, and a link goes if either end did."""
    part = Model(spark, sf_dir).table("part")
    none = [F.lit(None).cast("string").alias(c) for c in ("container_uri", "class_id", "name")]
    things = part.select(F.lit("thing").alias("kind"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("uri"), *none, F.create_map(F.lit("brand"), F.col("p_brand")).alias("fields"), "p_size")
    ends = F.create_map(F.lit("source"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.lit("target"), F.concat(F.lit("p"), F.expr("p_partkey div 10").cast("string")))
    links = part.where("p_partkey >= 10").select(F.lit("link").alias("kind"), F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("uri"), *none, ends.alias("fields"), F.lit(1).alias("p_size"))
    base = things.unionByName(links)
    side = lambda k: base.where(F.col("p_size") % k != 0).drop("p_size")
    return versions.merged_links(versions.merge(base.drop("p_size"), side(7), side(5))).select("uri")


@query(f"""WITH {SIDES} SELECT 'c' || k AS uri, CASE WHEN NOT o THEN 'removed' WHEN NOT b THEN 'added' ELSE 'modified' END AS ours_change, CASE WHEN NOT t THEN 'removed' WHEN NOT b THEN 'added' ELSE 'modified' END AS theirs_change,
  CASE WHEN b AND o AND t THEN concat_ws(',', CASE WHEN ob <> bb AND tb <> bb AND ob <> tb THEN 'balance' END, CASE WHEN os <> bs AND ts <> bs AND os <> ts THEN 'segment' END) END AS conflict_fields FROM M WHERE outcome = 'conflict'""")
def merge_conflicts(spark, sf_dir):
    return versions.conflicts(merged(Model(spark, sf_dir))).select("uri", "ours_change", "theirs_change", F.array_join("conflict_fields", ",").alias("conflict_fields"))


@query(f"WITH {SIDES} SELECT 'c' || k AS uri, CASE WHEN outcome <> 'conflict' OR k % 3 = 2 THEN outcome WHEN k % 3 = 0 THEN CASE WHEN o THEN 'ours' ELSE 'removed' END ELSE CASE WHEN t THEN 'theirs' ELSE 'removed' END END AS outcome FROM M")
def apply_resolutions(spark, sf_dir):
    m = Model(spark, sf_dir)
    key = m.table("customer").where("c_custkey % 3 != 2").select(F.lit("facet").alias("kind"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uri"), F.when(F.col("c_custkey") % 3 == 0, "ours").otherwise("theirs").alias("side"))
    return versions.resolve(merged(m), key).select("uri", "outcome")


@query(f"WITH {SIDES}, D AS ({DIFF}) SELECT uri, CASE change_type WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE 'modified' END AS change_type, true AS restored FROM D")
def reverse_changes(spark, sf_dir):
    """The reverse of base -> theirs, and whether applying it to theirs gives base's row again."""
    m = Model(spark, sf_dir)
    base, theirs = snapshot(m, "base"), snapshot(m, "theirs")
    back = versions.reverse(versions.diff(base, theirs))
    again = versions.apply_changes(versions.whole(theirs), back)
    rows = versions.whole(base).select("kind", "uri", F.array_sort(F.map_entries("row")).alias("_b")).join(again.select("kind", "uri", F.array_sort(F.map_entries("row")).alias("_a")), ["kind", "uri"], "full_outer")
    return back.join(rows, ["kind", "uri"], "left").select("uri", "change_type", F.col("_a").eqNullSafe(F.col("_b")).alias("restored"))


@query("""SELECT 'context' AS kind, count(*) AS n FROM C WHERE uri <> 'bm:ctx:r2' AND coalesce(parent_uri, '') <> 'bm:ctx:r2' UNION ALL SELECT 'entity', count(*) FROM E WHERE container_uri NOT IN (SELECT uri FROM C WHERE parent_uri = 'bm:ctx:r2')
  UNION ALL SELECT 'link', count(*) FROM L WHERE source_uri NOT IN (SELECT uri FROM D) AND target_uri NOT IN (SELECT uri FROM D) UNION ALL SELECT 'pruned', count(*) FROM L WHERE source_uri IN (SELECT uri FROM D) OR target_uri IN (SELECT uri FROM D)""".replace("(SELECT uri FROM D)", "(SELECT uri FROM C WHERE uri = 'bm:ctx:r2' OR parent_uri = 'bm:ctx:r2' UNION ALL SELECT uri FROM E WHERE container_uri IN (SELECT uri FROM C WHERE parent_uri = 'bm:ctx:r2'))"), "C E L")
def cascade_remove(spark, sf_dir):
    m = Model(spark, sf_dir)
    gone = m.contexts.where("uri = 'bm:ctx:r2'").select("uri")
    parts = versions.cascade_remove(graph.context_tree(m.contexts), m.contexts, m.entities, m.links, gone)
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, rows in zip(("context", "entity", "link", "pruned"), parts, strict=True)]
    return triples.union(*counts)


@query("SELECT 'bm:thing:p' || p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'Action' ELSE 'Thing' END AS class_id, CASE WHEN p_size % 10 = 0 AND p_size % 3 = 2 THEN p_type END AS description, p_name AS name FROM part")
def bulk_retype(spark, sf_dir):
    m = Model(spark, sf_dir)
    changes = sets.ids(m.parts.where(number_of(field("size")) % 10 == 0)).withColumn("new_class", F.lit("Action"))
    rows = versions.retype(m.parts, changes)
    return rows.select(F.col("uri").alias("id"), "class_id", F.nullif(F.trim(string_of(field("description"))), F.lit("")).alias("description"), "name")


@query("""SELECT L.source_uri, L.predicate, L.target_uri FROM L WHERE L.predicate IN ('stewards', 'extends')
    AND (L.predicate <> 'stewards' OR L.target_uri NOT IN (SELECT 'bm:thing:p' || p_partkey FROM part WHERE p_size % 10 = 0))""", "L")
def bulk_retype_links(spark, sf_dir):
    """Parts that become actions lose their stewards; extends links, which actions may have, stay."""
    m = Model(spark, sf_dir)
    changes = sets.ids(m.parts.where(number_of(field("size")) % 10 == 0)).withColumn("new_class", F.lit("Action"))
    _, links = versions.retype_model(m.parts, m.links.where("predicate in ('stewards', 'extends')"), changes)
    return links.select("source_uri", "predicate", "target_uri")


@query("""SELECT 'bm:symbol:d' || doc_id AS source_uri, 'bm:thing:p' || (doc_id % 50) AS target_uri FROM documents WHERE doc_id % 2 = 1""")
def bulk_classify_links(spark, sf_dir):
    """Symbols that become Things lose the annotations that only symbols may make."""
    m = Model(spark, sf_dir)
    docs = m.table("documents")
    links = docs.select(F.lit("tpch").alias("map_id"), uri("symbol:d", "doc_id").alias("source_uri"), F.lit("annotates").alias("predicate"), F.concat(F.lit("bm:thing:p"), (F.col("doc_id") % 50).cast("string")).alias("target_uri"))
    choices = docs.where("doc_id % 2 = 0").select(F.lit("tpch").alias("map_id"), uri("symbol:d", "doc_id").alias("uri"), F.lit("Thing").alias("new_class"))
    _, led = versions.classify_model(m.symbols, links, choices, texts.symbol_name(F.lit(None).cast("string"), string_of(field("content"))))
    return led.select("source_uri", "target_uri")


@query("""SELECT 'bm:facet:' || sha256('bm:symbol:d' || doc_id) AS source_uri, 'bm:thing:p' || (doc_id % 50) AS target_uri FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'bm:symbol:d' || doc_id, 'bm:thing:p' || (doc_id % 50) FROM documents WHERE doc_id % 2 = 1""")
def bulk_classify(spark, sf_dir):
    m = Model(spark, sf_dir)
    docs = m.table("documents")
    links = docs.select(uri("symbol:d", "doc_id").alias("source_uri"), F.lit("annotates").alias("predicate"), F.concat(F.lit("bm:thing:p"), (F.col("doc_id") % 50).cast("string")).alias("target_uri"))
    choices = docs.where("doc_id % 2 = 0").select(uri("symbol:d", "doc_id").alias("uri"), F.lit("Thing").alias("new_class"))
    _, led = versions.classify(m.symbols, links, choices, texts.symbol_name(F.lit(None).cast("string"), string_of(field("content"))))
    return led.select("source_uri", "target_uri")


@query("SELECT 'bm:ctx:n' || CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_nationkey END AS container_uri, count(*) AS n FROM customer GROUP BY 1")
def bulk_move(spark, sf_dir):
    m = Model(spark, sf_dir)
    moves = m.customers.where(sets.has_tag("BUILDING")).select("map_id", "uri", F.lit("bm:ctx:n0").alias("to"))
    return versions.move(m.customers, moves).groupBy("container_uri").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'bm:' || sha256('copy|' || source_uri) AS source_uri, CASE WHEN target_uri IN (SELECT 'bm:thing:p' || p_partkey FROM part) THEN 'bm:' || sha256('copy|' || target_uri) ELSE target_uri END AS target_uri FROM X""", "X")
def re_id(spark, sf_dir):
    m = Model(spark, sf_dir)
    _, _, links = versions.re_id("copy", m.contexts, m.parts, m.extends)
    return links.select("source_uri", "target_uri")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 5 < 1 AND p_size % 2 = 0 THEN 'decimal' WHEN p_size % 5 < 1 THEN 'text' WHEN p_size % 2 = 0 THEN 'number' ELSE 'odd' END AS type, CASE WHEN p_size % 5 < 2 THEN 'card' ELSE 'doc' END AS mode,
  p_size % 5 < 3 AS has_doc, CASE WHEN p_size % 5 < 4 THEN 1 ELSE 0 END AS n_files, greatest(p_size % 5, 4) AS version FROM part""")
def migrate_models(spark, sf_dir):
    part = Model(spark, sf_dir).table("part")
    entity = F.struct(uri("thing:p", "p_partkey").alias("uri"), F.when(F.col("p_size") % 2 == 0, "number").otherwise("odd").alias("type"), F.lit("doc").alias("mode"), F.col("p_name").alias("content"), F.lit(None).cast("string").alias("contentDoc"), F.lit("file").alias("attachment"), F.array().cast("array<string>").alias("attachments"))
    old = part.select("p_partkey", (F.col("p_size") % 5).alias("version"), F.array(entity).alias("entities"))
    done = versions.migrate(versions.migrate(old)).select("p_partkey", "version", F.explode("entities").alias("e"))
    return done.select(F.col("p_partkey").alias("id"), "e.type", "e.mode", F.col("e.contentDoc").isNotNull().alias("has_doc"), F.size("e.attachments").alias("n_files"), "version")


# Triples.
@query("""SELECT predicate AS p, count(*) AS n FROM L GROUP BY 1 UNION ALL SELECT 'rdf:type', (SELECT count(*) FROM E) + (SELECT count(*) FROM C)
  UNION ALL SELECT 'rdfs:label', (SELECT count(*) FROM E) + (SELECT count(*) FROM C) UNION ALL SELECT 'memberOf', count(*) FROM E UNION ALL SELECT 'childOf', count(parent_uri) FROM C UNION ALL SELECT 'hasTag', (SELECT count(tag) FROM E) + (SELECT count(tag) FROM C)""", "C E L")
def model_triples(spark, sf_dir):
    return triples.model_triples(Model(spark, sf_dir)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


DECLARED = """A AS (SELECT 'bm:thing:p' || p_partkey AS thing, 'brand' || CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size % 5 AS VARCHAR) END AS name, 'text' AS type FROM part
  UNION ALL SELECT 'bm:thing:p' || p_partkey, 'size', 'integer' FROM part WHERE p_size > 25 UNION ALL SELECT 'bm:thing:p' || p_partkey, 'like', 'reference' FROM part WHERE p_size % 4 = 0)"""


@query(f"""WITH {DECLARED} SELECT X.source_uri AS s, 'inheritedAttribute' AS p, A.name || ':' || A.type || ':' || X.target_uri AS o FROM X JOIN A ON A.thing = X.target_uri
    WHERE X.source_uri IN (SELECT 'bm:thing:p' || p_partkey FROM part) AND NOT EXISTS (SELECT 1 FROM A B WHERE B.thing = X.source_uri AND B.name = A.name)
  UNION ALL SELECT thing, 'references', 'bm:thing:p1' FROM A WHERE type = 'reference'""", "X")
def inherited_attribute_triples(spark, sf_dir):
    """Parts that declare attributes: those inherited by name, over every extends link, and the references."""
    m = Model(spark, sf_dir)
    size = number_of(field("size")).cast("int")
    one = lambda name, kind, test=F.lit(True): F.when(test, F.struct(name.alias("name"), F.lit(kind).alias("type"), F.when(F.lit(kind) == "reference", F.lit("bm:thing:p1")).alias("referencedThingId")))
    brand = F.when(size % 3 == 0, "brand").otherwise(F.concat(F.lit("brand"), (size % 5).cast("string")))
    declared = F.array_compact(F.array(one(brand, "text"), one(F.lit("size"), "integer", size > 25), one(F.lit("like"), "reference", size % 4 == 0)))
    things = m.parts.withColumn("fields", F.create_map(F.lit("attributes"), F.to_json(declared)))
    attributes = triples.attributes_of(things)
    return triples.inherited_triples(m.extends, things, attributes).unionByName(triples.reference_triples(attributes))


@query("""SELECT 'bm:inst:' || c_custkey AS s, 'attr/segment' AS p, c_mktsegment AS o FROM customer UNION ALL SELECT 'bm:inst:' || c_custkey, 'attr/name', c_name FROM customer UNION ALL SELECT 'bm:inst:' || c_custkey, 'attr/nation', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'bm:inst:' || c_custkey, 'rdf:type', 'bm:EntityInstance' FROM customer UNION ALL SELECT 'bm:inst:' || c_custkey, 'instanceOf', 'thing:customer' FROM customer UNION ALL SELECT 'bm:inst:' || c_custkey, 'createdAt', CAST(1700000000 + c_custkey % 977 AS VARCHAR) FROM customer
  UNION ALL SELECT 'bm:inst:' || c_custkey, 'inContext', 'bm:ctx:n' || c_nationkey FROM customer UNION ALL SELECT 'bm:inst:' || o_custkey, 'placed', 'bm:order:' || o_orderkey FROM orders""")
def instance_triples(spark, sf_dir):
    m = Model(spark, sf_dir)
    return triples.instance_triples(m.instances, m.relationships).where("p != 'attr/balance'")


def runs(m: Model):
    return m.table("part").select(F.concat(F.lit("run:"), F.col("p_partkey").cast("string")).alias("uri"), F.concat(F.lit("pipe:"), (F.col("p_partkey") % 5).cast("string")).alias("pipeline"), F.when(F.col("p_size") % 4 == 0, "failed").otherwise("completed").alias("status"))


def produced(m: Model):
    data = F.create_map(F.lit("name"), quoted(F.col("c_name")))
    return m.table("customer").select(uri("inst:", "c_custkey").alias("uri"), F.lit("bm:thing:customer").alias("type_uri"), data.alias("data"), F.concat(F.lit("run:"), (F.col("c_custkey") % 100).cast("string")).alias("run"))


@query("""SELECT 'bm:inst:' || c_custkey AS s, 'rdf:type' AS p, 'bm:thing:customer' AS o FROM customer UNION ALL SELECT 'bm:inst:' || c_custkey, 'rdfs:label', c_name FROM customer UNION ALL SELECT 'bm:inst:' || c_custkey, 'producedBy', 'run:' || (c_custkey % 100) FROM customer
  UNION ALL SELECT 'run:' || p_partkey, 'runFor', 'pipe:' || (p_partkey % 5) FROM part UNION ALL SELECT 'bm:inst:' || c_custkey, 'retried', 'true' FROM customer WHERE c_acctbal < 0""")
def m0_triples(spark, sf_dir):
    m = Model(spark, sf_dir)
    marks = m.table("customer").where("c_acctbal < 0").select(uri("inst:", "c_custkey").alias("s"), F.lit("retried").alias("p"), F.lit("true").alias("o"))
    return triples.runtime_triples(produced(m), runs(m), marks)


@query("SELECT 'pipe:' || (p_partkey % 5) AS pipeline, 'run:' || p_partkey AS run, 'bm:inst:' || c_custkey AS instance FROM customer JOIN part ON p_partkey = c_custkey % 100 WHERE p_size % 4 = 0")
def run_lineage(spark, sf_dir):
    m = Model(spark, sf_dir)
    return joins.run_lineage(triples.runtime_triples(produced(m), runs(m)), runs(m), "failed").select("pipeline", "run", "instance")


@query("SELECT source_uri AS s, 'stewards' AS p, target_uri AS o FROM L WHERE predicate = 'stewards' AND target_uri = 'bm:thing:p5' UNION ALL SELECT 'bm:thing:p' || p_partkey, 'hasTag', 'Brand#2' FROM part WHERE p_brand = 'Brand#2'", "L")
def triple_lookup(spark, sf_dir):
    found = triples.model_triples(Model(spark, sf_dir))
    return joins.lookup(found, p="stewards", o="bm:thing:p5").unionByName(joins.lookup(found, p="hasTag", o="Brand#2"))


# Texts: a small fixed note per document (its source, lang and id filled in) with marks of every kind.
NOTE = """concat_ws(chr(10), '# ' || source, '', 'See @[Thing:Part ' || (doc_id % 9) || ':p' || (doc_id % 50) || '] and @[Old](thing:p' || (doc_id % 7) || ')', 'more', '- one', '- two', '1. first', '3. second', '> said', '---', '- [x] done', '- [ ] open', '```py', '# code', '', '```', lang)"""


def notes(m: Model):
    c = F.col
    mention = F.concat(F.lit("See @[Thing:Part "), (c("doc_id") % 9).cast("string"), F.lit(":p"), (c("doc_id") % 50).cast("string"), F.lit("] and @[Old](thing:p"), (c("doc_id") % 7).cast("string"), F.lit(")"))
    lines = [F.concat(F.lit("# "), c("source")), F.lit(""), mention, *[F.lit(x) for x in ("more", "- one", "- two", "1. first", "3. second", "> said", "---", "- [x] done", "- [ ] open", "```py", "# code", "", "```")], c("lang")]
    return m.table("documents").select(uri("symbol:d", "doc_id").alias("uri"), F.concat_ws("\n", *lines).alias("content"))


@query("""SELECT 'bm:symbol:d' || doc_id AS uri, 'Thing' AS kind, 'Part ' || (doc_id % 9) AS label, 'p' || (doc_id % 50) AS id, CAST(length(source) + 9 AS INTEGER) AS start FROM documents
  UNION ALL SELECT 'bm:symbol:d' || doc_id, 'thing', 'Old', 'p' || (doc_id % 7), CAST(length(source) + 9 + 18 + length('p' || (doc_id % 50)) + 3 AS INTEGER) FROM documents""")
def mentions(spark, sf_dir):
    return texts.mentions(notes(Model(spark, sf_dir))).select("uri", "kind", "label", "id", "start")


@query("SELECT 'bm:symbol:d' || doc_id AS uri, '@[Thing:Part ' || (doc_id % 9) || ':p' || (doc_id % 50) || ']' AS token FROM documents UNION ALL SELECT 'bm:symbol:d' || doc_id, '@[thing:Old:p' || (doc_id % 7) || ']' FROM documents")
def serialize_mention(spark, sf_dir):
    found = texts.mentions(notes(Model(spark, sf_dir)))
    return found.select("uri", texts.mention_token(F.col("kind"), F.col("label"), F.col("id"), F.col("context")).alias("token"))


@query(f"""WITH T AS (SELECT 'bm:symbol:d' || doc_id AS uri, {NOTE} AS x, '@[Thing:Part ' || (doc_id % 9) || ':p' || (doc_id % 50) || ']' AS k FROM documents)
  SELECT uri, 0 AS position, 'text' AS kind, split_part(x, k, 1) AS value FROM T UNION ALL SELECT uri, 1, 'mention', k FROM T UNION ALL SELECT uri, 2, 'text', split_part(x, k, 2) FROM T""")
def mention_segments(spark, sf_dir):
    return texts.segments(notes(Model(spark, sf_dir)))


BLOCKS = """(SELECT 'bm:symbol:d' || doc_id AS uri, unnest([
  {'i': 0, 't': 'heading', 'l': 1, 'g': NULL, 'c': NULL, 'x': source}, {'i': 1, 't': 'paragraph', 'l': NULL, 'g': NULL, 'c': NULL, 'x': ''},
  {'i': 2, 't': 'paragraph', 'l': NULL, 'g': NULL, 'c': NULL, 'x': 'See @[Thing:Part ' || (doc_id % 9) || ':p' || (doc_id % 50) || '] and @[Old](thing:p' || (doc_id % 7) || ')' || chr(10) || 'more'},
  {'i': 3, 't': 'bullet', 'l': NULL, 'g': NULL, 'c': NULL, 'x': 'one' || chr(10) || 'two'}, {'i': 4, 't': 'ordered', 'l': NULL, 'g': NULL, 'c': NULL, 'x': 'first' || chr(10) || 'second'},
  {'i': 5, 't': 'quote', 'l': NULL, 'g': NULL, 'c': NULL, 'x': 'said'}, {'i': 6, 't': 'rule', 'l': NULL, 'g': NULL, 'c': NULL, 'x': ''},
  {'i': 7, 't': 'task', 'l': NULL, 'g': NULL, 'c': 'xo', 'x': 'done' || chr(10) || 'open'}, {'i': 8, 't': 'code', 'l': NULL, 'g': 'py', 'c': NULL, 'x': '# code' || chr(10)},
  {'i': 9, 't': 'paragraph', 'l': NULL, 'g': NULL, 'c': NULL, 'x': lang}]) AS b FROM documents)"""


@query(f"SELECT uri, CAST(b.i AS INTEGER) AS block_index, b.t AS block_type, CAST(b.l AS INTEGER) AS level, b.g AS language, b.c AS checked, b.x AS text FROM {BLOCKS}")
def doc_blocks(spark, sf_dir):
    return texts.blocks(notes(Model(spark, sf_dir)))


@query(f"SELECT 'bm:symbol:d' || doc_id AS uri, replace({NOTE}, '3. second', '2. second') AS content FROM documents")
def blocks_to_text(spark, sf_dir):
    return texts.blocks_to_text(texts.blocks(notes(Model(spark, sf_dir))))


@query(f"""SELECT p, count(*) AS n FROM (SELECT uri, 'hasPart' AS p FROM {BLOCKS} UNION ALL SELECT uri, 'blockIndex' FROM {BLOCKS} UNION ALL SELECT uri, 'blockType' FROM {BLOCKS} UNION ALL SELECT uri, 'blockLevel' FROM {BLOCKS} WHERE b.l IS NOT NULL
  UNION ALL SELECT uri, 'blockLanguage' FROM {BLOCKS} WHERE b.g IS NOT NULL UNION ALL SELECT uri, 'blockChecked' FROM {BLOCKS} WHERE b.c IS NOT NULL UNION ALL SELECT uri, 'blockText' FROM {BLOCKS} WHERE b.x <> ''
  UNION ALL SELECT DISTINCT doc_id || '#' || unnest([doc_id % 50, doc_id % 7]), 'mentions' FROM documents) GROUP BY 1""")
def doc_triples(spark, sf_dir):
    rows = notes(Model(spark, sf_dir))
    return texts.doc_triples(texts.blocks(rows), texts.mentions(rows)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


# The same over the documents' whole texts: every line as it is, marks before or between them.
MARKS = ["# ", "", "", "- ", "- ", "1. ", "2. ", "> ", "@[Thing:Part 3:p5] ", "- [x] ", "- [ ] ", "```", "", "---\n", "@[Old](thing:p7) ", "## "]
CANON = r"@\[[^:\[\]]+:[^:\[\]]*:[^:\[\]]+(?::[^:\[\]]+)?\]"
OLD = r"@\[[^\[\]]+\]\([a-zA-Z]+:[^()\s]+\)"
WHOLE = """S AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  W AS (SELECT 'bm:symbol:d' || doc_id AS uri, string_agg(([%s])[CAST((doc_id + i - 1) %% 16 AS INTEGER) + 1] || line, chr(10) ORDER BY i) AS x FROM S GROUP BY doc_id)""" % ", ".join("'---' || chr(10)" if "\n" in x else f"'{x}'" for x in MARKS)
PIECES = """%(name)s AS (SELECT uri, 2 * i AS j, part AS value FROM (SELECT uri, unnest(string_split_regex(x, '%(of)s')) AS part, generate_subscripts(string_split_regex(x, '%(of)s'), 1) AS i FROM W)
  UNION ALL SELECT uri, 2 * i + 1, token FROM (SELECT uri, unnest(regexp_extract_all(x, '%(of)s')) AS token, generate_subscripts(regexp_extract_all(x, '%(of)s'), 1) AS i FROM W))"""
FOUND = f"""{WHOLE}, {PIECES % {"name": "PC", "of": CANON}}, {PIECES % {"name": "PO", "of": OLD}},
  M AS (SELECT uri, CAST(before + 1 AS INTEGER) AS start, value AS token, j FROM (SELECT *, sum(length(value)) OVER (PARTITION BY uri ORDER BY j) - length(value) AS before FROM PC) WHERE j % 2 = 1),
  MO AS (SELECT uri, CAST(before + 1 AS INTEGER) AS start, value AS token, j FROM (SELECT *, sum(length(value)) OVER (PARTITION BY uri ORDER BY j) - length(value) AS before FROM PO) WHERE j % 2 = 1)"""
SPLIT = WHOLE + """,
  S1 AS (SELECT uri, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS n FROM W),
  S2 AS (SELECT *, starts_with(line, '```') AS fence, CAST(sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY n) AS BIGINT) AS fences FROM S1),
  S3 AS (SELECT *, CASE WHEN fences % 2 = 1 OR fence THEN 'code' WHEN regexp_matches(line, '^#{1,3} ') THEN 'heading' WHEN regexp_matches(line, '^-{3,}\\s*$') THEN 'rule' WHEN starts_with(line, '>') THEN 'quote'
    WHEN regexp_matches(line, '^[-*] \\[[ xX]\\] ') THEN 'task' WHEN regexp_matches(line, '^[-*] ') THEN 'bullet' WHEN regexp_matches(line, '^[0-9]+\\. ') THEN 'ordered' WHEN trim(line) = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM S2),
  S4 AS (SELECT *, CASE WHEN kind = 'code' THEN (fences + 1) // 2 END AS code FROM S3),
  S5 AS (SELECT *, lag(kind) OVER (PARTITION BY uri ORDER BY n) AS kind0, lag(code) OVER (PARTITION BY uri ORDER BY n) AS code0 FROM S4),
  S6 AS (SELECT *, CAST(sum(CASE WHEN n = 1 OR kind IN ('heading', 'rule', 'blank') OR kind <> kind0 OR code <> code0 THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY n) - 1 AS INTEGER) AS block_index,
    CASE WHEN fence THEN NULL WHEN kind IN ('rule', 'blank') THEN '' WHEN kind IN ('code', 'paragraph') THEN line WHEN kind = 'quote' THEN regexp_replace(line, '^> ?', '') WHEN kind = 'task' THEN substr(line, 7)
      WHEN kind = 'bullet' THEN substr(line, 3) ELSE substr(line, instr(line, ' ') + 1) END AS plain FROM S5),
  B AS (SELECT uri, block_index, CASE min(kind) WHEN 'blank' THEN 'paragraph' ELSE min(kind) END AS block_type, CAST(max(CASE WHEN kind = 'heading' THEN instr(line, ' ') - 1 END) AS INTEGER) AS level,
    max(CASE WHEN fence AND fences % 2 = 1 THEN nullif(trim(substr(line, 4)), '') END) AS language, nullif(string_agg(CASE WHEN kind = 'task' THEN CASE WHEN substr(line, 4, 1) = ' ' THEN 'o' ELSE 'x' END END, '' ORDER BY n), '') AS checked,
    coalesce(string_agg(plain, chr(10) ORDER BY n), '') AS text FROM S6 GROUP BY 1, 2)"""


def whole(m: Model):
    c = F.col
    marks = F.array(*[F.lit(x) for x in MARKS])
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.element_at(marks, ((c("doc_id") + i) % len(MARKS) + 1).cast("int")), x))
    return m.table("documents").select(uri("symbol:d", "doc_id").alias("uri"), F.array_join(lines, "\n").alias("content"))


@query(f"""WITH {FOUND} SELECT uri, start, token, regexp_extract(token, '^@.([^:]+):', 1) AS kind, split_part(token, ':', 2) AS label, regexp_extract(token, ':([^:]+).$', 1) AS id FROM M
  UNION ALL SELECT uri, start, token, 'thing', 'Old', 'p7' FROM MO""")
def whole_mentions(spark, sf_dir):
    return texts.mentions(whole(Model(spark, sf_dir))).select("uri", "start", "token", "kind", "label", "id")


@query(f"WITH {FOUND} SELECT uri, token FROM M UNION ALL SELECT uri, '@[thing:Old:p7]' FROM MO")
def whole_tokens(spark, sf_dir):
    found = texts.mentions(whole(Model(spark, sf_dir)))
    return found.select("uri", texts.mention_token(F.col("kind"), F.col("label"), F.col("id"), F.col("context")).alias("token"))


@query(f"WITH {FOUND} SELECT uri, CAST(row_number() OVER (PARTITION BY uri ORDER BY j) - 1 AS INTEGER) AS position, CASE j % 2 WHEN 1 THEN 'mention' ELSE 'text' END AS kind, value FROM PC WHERE value <> ''")
def whole_segments(spark, sf_dir):
    return texts.segments(whole(Model(spark, sf_dir)))


@query(f"WITH {SPLIT} SELECT * FROM B")
def whole_blocks(spark, sf_dir):
    return texts.blocks(whole(Model(spark, sf_dir)))


@query(f"""WITH {SPLIT}, R AS (SELECT uri, n, block_index, CASE WHEN fence AND fences % 2 = 1 THEN '```' || trim(substr(line, 4)) || CASE WHEN lead(block_index) OVER (PARTITION BY uri ORDER BY n) = block_index AND NOT lead(fence) OVER (PARTITION BY uri ORDER BY n) THEN '' ELSE chr(10) END
    WHEN fence THEN '```' WHEN kind = 'rule' THEN '---' WHEN kind = 'quote' THEN '> ' || plain WHEN kind = 'bullet' THEN '- ' || plain WHEN kind = 'task' THEN CASE WHEN substr(line, 4, 1) = ' ' THEN '- [ ] ' ELSE '- [x] ' END || plain
    WHEN kind = 'ordered' THEN row_number() OVER (PARTITION BY uri, block_index ORDER BY n) || '. ' || plain WHEN kind = 'blank' THEN '' ELSE line END
    || CASE WHEN kind = 'code' AND lead(n) OVER (PARTITION BY uri ORDER BY n) IS NULL AND fences % 2 = 1 THEN chr(10) || '```' ELSE '' END AS made FROM S6)
  SELECT uri, string_agg(made, chr(10) ORDER BY n) AS content FROM R GROUP BY 1""")
def whole_blocks_to_text(spark, sf_dir):
    return texts.blocks_to_text(texts.blocks(whole(Model(spark, sf_dir))))


@query(f"""WITH {SPLIT}, {FOUND[len(WHOLE) + 2:]} SELECT uri AS s, 'hasPart' AS p, uri || '#' || block_index AS o FROM B UNION ALL SELECT uri || '#' || block_index, 'blockIndex', CAST(block_index AS VARCHAR) FROM B UNION ALL SELECT uri || '#' || block_index, 'blockType', block_type FROM B
  UNION ALL SELECT uri || '#' || block_index, 'blockLevel', CAST(level AS VARCHAR) FROM B WHERE level IS NOT NULL UNION ALL SELECT uri || '#' || block_index, 'blockLanguage', language FROM B WHERE language IS NOT NULL
  UNION ALL SELECT uri || '#' || block_index, 'blockChecked', checked FROM B WHERE checked IS NOT NULL UNION ALL SELECT uri || '#' || block_index, 'blockText', text FROM B WHERE text <> ''
  UNION ALL SELECT DISTINCT uri, 'mentions', regexp_extract(token, ':([^:]+).$', 1) FROM (SELECT uri, token FROM M UNION ALL SELECT uri, token FROM MO)""")
def whole_doc_triples(spark, sf_dir):
    rows = whole(Model(spark, sf_dir))
    return texts.doc_triples(texts.blocks(rows), texts.mentions(rows))


@query(f"""WITH {SPLIT}, I AS (SELECT uri || '#' || block_index || '/' || (row_number() OVER (PARTITION BY uri, block_index ORDER BY n) - 1) AS s, kind, trim(plain) AS said, substr(line, 4, 1) AS tick FROM S6 WHERE kind IN ('bullet', 'ordered', 'task'))
  SELECT s, 'blockType' AS p, CASE WHEN kind = 'task' THEN 'taskItem' ELSE 'listItem' END AS o FROM I UNION ALL SELECT s, 'blockText', said FROM I WHERE said <> '' UNION ALL SELECT s, 'blockChecked', CASE WHEN tick = ' ' THEN 'false' ELSE 'true' END FROM I WHERE kind = 'task'""")
def whole_item_triples(spark, sf_dir):
    """Items of the lists in whole texts."""
    return texts.item_triples(texts.blocks(whole(Model(spark, sf_dir))))


@query("""SELECT p_partkey AS id, replace(replace(replace(replace(url_encode(p_type || ' (' || p_name || ')' || '*~!'''), '%28', '('), '%29', ')'), '%27', ''''), '%21', '!') AS encoded FROM part""".replace("url_encode(p_type", "replace(url_encode(p_type").replace("'*~!''')", "'*~!'''), '%2A', '*')"))
def iri_encode(spark, sf_dir):
    text = F.concat("p_type", F.lit(" ("), "p_name", F.lit(")*~!'"))
    return Model(spark, sf_dir).table("part").select(F.col("p_partkey").alias("id"), triples.iri_encode(text).alias("encoded"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN source WHEN trim(substr(split_part(text, chr(10), 1), 1, 80)) = '' THEN 'Untitled' ELSE trim(substr(split_part(text, chr(10), 1), 1, 80)) END AS name FROM documents")
def symbol_name(spark, sf_dir):
    label = F.when(F.col("doc_id") % 4 == 0, F.col("source")).when(F.col("doc_id") % 4 == 1, "")
    return Model(spark, sf_dir).table("documents").select(F.col("doc_id").alias("id"), texts.symbol_name(label, F.col("text")).alias("name"))


@query("SELECT c_custkey AS id, 'bm:identity:' || c_name AS uri, c_name AS back FROM customer")
def identity_uri(spark, sf_dir):
    made = texts.identity_uri(F.col("c_name"))
    return Model(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("id"), made.alias("uri"), texts.identity_of(made).alias("back"))


# Actions.
def requests(m: Model):
    c = F.col
    action = F.concat(F.lit("act"), (c("o_orderkey") % 4).cast("string"))
    params = F.map_filter(F.create_map(F.lit("total"), F.when(c("o_orderkey") % 5 != 0, c("o_totalprice").cast("string")), F.lit("note"), F.when(c("o_orderkey") % 7 == 0, F.lit("12")).otherwise(quoted(c("o_orderpriority")))), lambda _, v: v.isNotNull())
    return m.table("orders").select(c("o_orderkey").alias("request"), action.alias("action"), c("o_custkey").cast("string").alias("user"), params.alias("params"))


def gated(m: Model):
    spark = m.spark
    acts = spark.sql("SELECT * FROM VALUES ('act0', false), ('act1', true), ('act2', false) AS t(action, performers_only)")
    params = spark.sql("SELECT a AS action, n AS name, t AS type, r AS required FROM VALUES ('total', 'number', true), ('note', 'text', false) AS p(n, t, r) LATERAL VIEW explode(array('act0', 'act1', 'act2')) x AS a")
    performers = m.table("customer").where("c_mktsegment = 'BUILDING'").select(F.lit("act1").alias("action"), F.col("c_custkey").cast("string").alias("user"))
    facts = m.table("part").select(F.lit("thing").alias("thing"), F.col("p_brand").alias("state"))
    needs = spark.sql("SELECT 'act2' AS action, 'thing' AS thing, 'Brand#none' AS state")
    return actions.gate(requests(m), acts, params, performers, facts, needs)


GATE = """G AS (SELECT o_orderkey AS request, o_custkey, o_totalprice, o_orderkey % 4 AS a, CASE WHEN o_orderkey % 4 = 3 THEN 'no-action' WHEN o_orderkey % 5 = 0 THEN 'missing-param' WHEN o_orderkey % 7 = 0 THEN 'param-type'
  WHEN o_orderkey % 4 = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'not-allowed' WHEN o_orderkey % 4 = 2 THEN 'precondition' END AS fault FROM orders)"""


@query(f"WITH {GATE} SELECT request, fault FROM G")
def action_gate(spark, sf_dir):
    return gated(Model(spark, sf_dir)).select("request", "fault")


@query(f"""WITH {GATE} SELECT request, 1 AS step, 'create' AS effect, 'new/' || request || '/1' AS target, 'total' AS field, o_totalprice AS value FROM G WHERE fault IS NULL AND a = 0
  UNION ALL SELECT request, 1, 'modify', (SELECT min('bm:inst:' || c_custkey) FROM customer), 'by', CAST(o_custkey AS DOUBLE) FROM G WHERE fault IS NULL AND a = 1""")
def action_effects(spark, sf_dir):
    m = Model(spark, sf_dir)
    rules = spark.sql("SELECT * FROM VALUES ('act0', 1, 'create', 'thing:customer', 'total', 'param', 'total'), ('act1', 1, 'modify', 'thing:customer', 'by', 'user', null) AS t(action, step, effect, thing, field, source, arg)")
    done = actions.effects(gated(m).where("fault is null"), rules, m.instances.select(F.col("thing_id").alias("thing"), "id"))
    return done.select("request", "step", "effect", "target", "field", F.col("value").try_cast("double").alias("value"))


@query("""WITH Q AS (SELECT o_orderkey AS request FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0), K AS (SELECT request, row_number() OVER (ORDER BY request) AS k FROM Q)
  SELECT request, 1 AS step, 'create' AS effect, 'new/' || request || '/1' AS target, 'total' AS field, CAST(o_totalprice AS VARCHAR) AS value FROM Q JOIN orders ON o_orderkey = request
  UNION ALL SELECT request, 2, 'transitionState', 'new/' || request || '/1', '_state', 'open' FROM Q
  UNION ALL SELECT request, 3, 'createLink', 'new/' || request || '/1', 'placed', 'bm:inst:1' FROM Q
  UNION ALL SELECT request, 4, 'deleteLink', 'bm:inst:' || (SELECT min(o_custkey) FROM orders), 'placed', rel FROM K JOIN (SELECT 'bm:rel:' || o_orderkey AS rel, row_number() OVER (ORDER BY 'bm:rel:' || o_orderkey) AS k FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)) USING (k)
  UNION ALL SELECT request, 5, CASE WHEN inst IS NULL THEN 'no-instance' ELSE 'delete' END, inst, NULL, NULL FROM K LEFT JOIN (SELECT 'bm:inst:' || c_custkey AS inst, row_number() OVER (ORDER BY 'bm:inst:' || c_custkey) AS k FROM customer) USING (k)
  UNION ALL SELECT request, 6, 'emit', 'event/' || request || '/6', 'by', CAST(o_custkey AS VARCHAR) FROM Q JOIN orders ON o_orderkey = request
  UNION ALL SELECT request, 7, 'no-instance', NULL, 'x', '1' FROM Q""")
def action_links(spark, sf_dir):
    """One action with every kind of effect, for all orders with sound parameters."""
    m = Model(spark, sf_dir)
    c = F.col
    asked = requests(m).where((c("request") % 5 != 0) & (c("request") % 7 != 0)).withColumn("action", F.lit("act"))
    first = m.table("orders").agg(F.min("o_custkey").alias("k")).select(F.concat(F.lit("bm:inst:"), c("k").cast("string")).alias("k")).first()["k"]
    columns = "action, step, effect, thing, field, source, arg, predicate, source_ref, target_ref"
    rows = [
        ("act", 1, "create", "thing:ticket", "total", "param", "total", None, None, None), ("act", 2, "transitionState", "thing:ticket", None, "static", "open", None, None, None),
        ("act", 3, "createLink", None, None, None, None, "placed", "thing:ticket", "bm:inst:1"), ("act", 4, "deleteLink", None, None, None, None, "placed", first, None),
        ("act", 5, "delete", "thing:customer", None, None, None, None, None, None), ("act", 6, "emit", None, "by", "user", None, None, None, None), ("act", 7, "modify", "thing:nothing", "x", "static", "1", None, None, None),
    ]
    rules = spark.createDataFrame(rows, "action string, step int, effect string, thing string, field string, source string, arg string, predicate string, source_ref string, target_ref string").select(columns.split(", "))
    return actions.effects(asked, rules, m.instances.select(c("thing_id").alias("thing"), "id"), m.relationships)


@query("""WITH Q AS (SELECT o_orderkey AS request, o_totalprice AS total, o_custkey AS who, o_orderdate AS ts, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'open' WHEN o_orderkey % 5 IN (2, 3) THEN 'close' ELSE 'note' END AS action FROM orders),
  C AS (SELECT *, coalesce(sum(CASE WHEN action = 'open' THEN 1 END) OVER w, 0) AS made, coalesce(sum(CASE WHEN action = 'close' THEN 1 END) OVER w, 0) AS asked FROM Q WINDOW w AS (ORDER BY request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  F AS (SELECT *, greatest(0, coalesce(max(CASE WHEN action = 'close' THEN asked + 1 - made END) OVER (ORDER BY request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS vain FROM C),
  H AS (SELECT F.*, CASE WHEN F.asked - F.vain < F.made THEN 'new/' || o.request || '/1' END AS head FROM F LEFT JOIN C o ON o.action = 'open' AND o.made = F.asked - F.vain AND F.action <> 'open'),
  G AS (SELECT *, 'new/' || request || '/1' AS me FROM H)
  SELECT request, 1 AS step, 'create' AS effect, me AS target, 'total' AS field, CAST(total AS VARCHAR) AS value FROM G WHERE action = 'open'
  UNION ALL SELECT request, 1, 'create', me, 'by', CAST(who AS VARCHAR) FROM G WHERE action = 'open'
  UNION ALL SELECT request, 1, 'create', me, 'at', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM G WHERE action = 'open'
  UNION ALL SELECT request, 2, 'create', 'new/' || request || '/2', 'paid', CAST(total AS VARCHAR) FROM G WHERE action = 'open'
  UNION ALL SELECT request, 3, 'emit', 'event/' || request || '/3', 'sum', CAST(total AS VARCHAR) FROM G WHERE action = 'open'
  UNION ALL SELECT request, 3, 'emit', 'event/' || request || '/3', 'lost', NULL FROM G WHERE action = 'open'
  UNION ALL SELECT request, 1, CASE WHEN head IS NULL THEN 'no-instance' ELSE 'delete' END, head, NULL, NULL FROM G WHERE action = 'close'
  UNION ALL SELECT request, 1, CASE WHEN head IS NULL THEN 'no-instance' ELSE 'transitionState' END, head, '_state', 'seen' FROM G WHERE action = 'note'""")
def action_queue(spark, sf_dir):
    """Requests that see each other's effects: tickets are opened, the oldest one is closed (or none is there) or marked; values
    come from a created row's attributes, through two steps, and from the request's time."""
    c = F.col
    action = F.when(c("o_orderkey") % 5 < 2, "open").when(c("o_orderkey") % 5 < 4, "close").otherwise("note")
    asked = Model(spark, sf_dir).table("orders").select(c("o_orderkey").alias("request"), action.alias("action"), c("o_custkey").cast("string").alias("user"), F.create_map(F.lit("total"), c("o_totalprice").cast("string")).alias("params"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    rules = spark.sql("""SELECT * FROM VALUES ('open', 1, 'create', 'ticket', 'total', 'param', 'total', null), ('open', 1, 'create', 'ticket', 'by', 'user', null, null), ('open', 1, 'create', 'ticket', 'at', 'time', null, null),
      ('open', 2, 'create', 'bill', 'paid', 'attribute', 'total', 'ticket'), ('open', 3, 'emit', null, 'sum', 'attribute', 'paid', 'bill'), ('open', 3, 'emit', null, 'lost', 'attribute', 'none', 'bill'),
      ('close', 1, 'delete', 'ticket', null, null, null, null), ('note', 1, 'transitionState', 'ticket', null, 'static', 'seen', null) AS t(action, step, effect, thing, field, source, arg, arg_thing)""")
    return actions.effects(asked, rules, spark.createDataFrame([], "thing string, id string"))


@query(f"""WITH {GATE} SELECT request, CASE WHEN a = 3 THEN 'no-action' WHEN fault IN ('missing-param', 'param-type') THEN fault WHEN a = 0 AND (SELECT max(c_acctbal) FROM customer) <= 5000 OR a = 2 AND (SELECT count(*) FROM customer WHERE c_mktsegment = 'NOWHERE') = 0 THEN 'precondition' END AS fault FROM G""")
def action_conditions(spark, sf_dir):
    """Gates with conditions on fields: some instance has a balance above 5,000; some is of a segment that isn't there."""
    m = Model(spark, sf_dir)
    acts = spark.sql("SELECT * FROM VALUES ('act0', false), ('act1', false), ('act2', false) AS t(action, performers_only)")
    params = spark.sql("SELECT a AS action, n AS name, t AS type, r AS required FROM VALUES ('total', 'number', true), ('note', 'text', false) AS p(n, t, r) LATERAL VIEW explode(array('act0', 'act1', 'act2')) x AS a")
    conditions = spark.sql("SELECT * FROM VALUES ('act0', 'thing:customer', 'balance', 'gt', '5000'), ('act0', 'thing:customer', 'name', 'exists', null), ('act1', 'thing:customer', 'nation', 'lt', '3'), ('act2', 'thing:customer', 'segment', 'equals', 'NOWHERE') AS t(action, thing, attribute, operator, value)")
    none = spark.createDataFrame([], "action string, user string")
    return actions.gate(requests(m), acts, params, none, instances=m.instances, conditions=conditions).select("request", "fault")


# Streams: the events table as files of a directory, read as a stream.


@query("""WITH S AS (SELECT *, 'ev' || event_id AS external_id FROM events WHERE event_type <> 'error' AND event_id % 13 <> 0 AND event_id % 17 <> 0) SELECT external_id, upper(event_type) AS kind, value AS amount FROM S""")
def stream_pipeline(spark, sf_dir):
    m = Model(spark, sf_dir)
    landed, out, checkpoint = files.scratch(spark, "landed"), files.scratch(spark, "out"), files.scratch(spark, "progress")
    responses(m).write.parquet(landed)
    stream = streams.files(spark, landed, "user_id bigint, page int, body string", 4)
    streams.pipeline(stream, lambda batch: mapping.run_mapping(mapping.iterate(batch, MAPPING.iterate), MAPPING).where("status = 'ok'"), out, checkpoint, ["type_uri", "external_id"], ["page", "record_index"]).awaitTermination()
    rows = streams.newest(spark, out, ["type_uri", "external_id"], ["page", "record_index"])
    return rows.select("external_id", string_of(field("kind")).alias("kind"), number_of(field("amount")).alias("amount"))


@query("SELECT event_id AS id FROM events WHERE event_id > (SELECT max(event_id) FROM events) // 2")
def incremental_cursor(spark, sf_dir):
    events = Model(spark, sf_dir).table("events")
    mark = events.agg(F.max("event_id").alias("m")).first()["m"] // 2
    return streams.cursor(spark, events, mark, "event_id").select(F.col("event_id").alias("id"))


@query("""WITH A AS (SELECT * FROM CMD WHERE class_id = 'Thing' OR class_id = 'Measure' AND kind = 'upsert'), T AS (SELECT user_id, max(sequence) FILTER (kind = 'upsert') AS up, max(sequence) FILTER (kind = 'delete') AS del FROM A GROUP BY 1)
  SELECT 'bm:user:' || T.user_id AS uri, CASE WHEN arg_max(A.event_type, A.sequence) IN ('signup', 'purchase') THEN arg_max(A.value, A.sequence) END AS value
  FROM T JOIN A ON A.user_id = T.user_id AND A.kind <> 'delete' WHERE T.up > coalesce(T.del, -1) GROUP BY T.user_id""", "CMD")
def stream_state(spark, sf_dir):
    m = Model(spark, sf_dir)
    landed, out, checkpoint = files.scratch(spark, "commands"), files.scratch(spark, "state"), files.scratch(spark, "progress")
    m.commits.repartitionByRange(8, "sequence").write.parquet(landed)
    streams.state(streams.files(spark, landed, m.commits.schema, 3), out, checkpoint).awaitTermination()
    rows = streams.state_of(spark, out)
    return rows.select("uri", number_of(F.element_at("data", "value")).alias("value"))


@query("""SELECT user_id AS run_id, count(*) FILTER (event_type = 'signup') AS started, count(*) FILTER (event_type = 'view') AS fetched, count(*) FILTER (event_type = 'click') AS mapped, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS error, max(ts) AS last_ts FROM events GROUP BY 1""")
def stream_run_metrics(spark, sf_dir):
    m = Model(spark, sf_dir)
    names = {"signup": "started", "view": "fetched", "click": "mapped", "purchase": "completed", "error": "error"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("event_type"))
    landed, checkpoint, out = files.scratch(spark, "events"), files.scratch(spark, "progress"), files.scratch(spark, "metrics")
    m.table("events").select(F.col("user_id").alias("run_id"), kind.alias("kind"), "ts").repartition(4).write.parquet(landed)
    metrics = streams.run_metrics(streams.files(spark, landed, "run_id bigint, kind string, ts timestamp"))
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")  # noqa: E731 - update mode: a run's last row counts
    metrics.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    names = ["started", "fetched", "mapped", "completed", "error", "last_ts"]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("run_id", "r.*")


@query("""SELECT event_type AS measure_id, CAST(user_id % 3 AS VARCHAR) AS dimension, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2, 3""")
def stream_measure_windows(spark, sf_dir):
    """The same windows from a stream in the order of time, three files a batch: a window is given out when the watermark has
    passed it, and the last ones by a closing point far behind."""
    m = Model(spark, sf_dir)
    landed, checkpoint, out = files.scratch(spark, "points"), files.scratch(spark, "progress"), files.scratch(spark, "windows")
    points = m.table("events").select(F.col("event_type").alias("measure_id"), (F.col("user_id") % 3).cast("string").alias("dimension"), F.col("ts").cast("timestamp").alias("ts"), "value")
    # Files are taken in the order of their names: ranges of time, then the closing point.
    points.repartitionByRange(6, "ts").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(landed)
    closing = points.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("measure_id"), F.lit("").alias("dimension"), (F.col("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"), F.lit(0.0).alias("value"), F.lit(9).alias("part"))
    closing.write.mode("append").partitionBy("part").parquet(landed)
    stream = streams.files(spark, landed, points.schema, 1)
    streams.windows(streams.measure_windows(stream, late="400 days"), out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out).where("measure_id != 'end'")
    return rows.select("measure_id", "dimension", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"), "low", "high")


@query("""SELECT event_type AS measure_id, CAST(user_id % 3 AS VARCHAR) AS dimension, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(*) >= 20 AS met FROM events GROUP BY 1, 2, 3""")
def measure_windows(spark, sf_dir):
    points = Model(spark, sf_dir).table("events").select(F.col("event_type").alias("measure_id"), (F.col("user_id") % 3).cast("string").alias("dimension"), "ts", "value")
    rows = streams.meets_target(streams.measure_windows(points), "n", 20)
    return rows.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


#: Measures with windows of their own length and aggregation.
DECLARED_MEASURES = {
    "signup": {"aggregation": "count", "window": (1, "days"), "min": 2, "direction": "higher-is-better"},
    "purchase": {"aggregation": "percentile", "window": (2, "weeks"), "quantile": 0.9, "max": 80, "direction": "lower-is-better"},
    "view": {"aggregation": "average", "window": (12, "hours"), "min": 20, "max": 60, "direction": "range"},
    "click": {"aggregation": "rate", "window": (6, "hours")},
    "error": {"aggregation": "ratio", "window": (3, "days"), "min": 0.5, "direction": "higher-is-better"},
}
DECLARED_SQL = """WITH M(m, kind, len, lo, hi, way) AS (VALUES ('signup', 'count', 86400, 2.0, NULL, 'up'), ('purchase', 'percentile', 1209600, NULL, 80.0, 'down'), ('view', 'average', 43200, 20.0, 60.0, 'in'), ('click', 'rate', 21600, NULL, NULL, NULL), ('error', 'ratio', 259200, 0.5, NULL, 'up')),
  W AS (SELECT m, kind, len, lo, hi, way, CAST(user_id % 3 AS VARCHAR) AS dimension, CAST(floor(epoch(ts) / len) AS BIGINT) * len AS start, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS v FROM events JOIN M ON m = event_type),
  A AS (SELECT m, kind, len, lo, hi, way, dimension, start, count(*) AS n, CASE kind WHEN 'count' THEN count(*) WHEN 'percentile' THEN quantile_disc(v, 0.9) WHEN 'average' THEN avg(v) WHEN 'rate' THEN count(*) / len ELSE count(*) FILTER (v <> 0) / count(*) END AS value FROM W GROUP BY m, kind, len, lo, hi, way, dimension, start)
  SELECT m AS measure_id, dimension, make_timestamp(start * 1000000) AS start, n, round(value, 6) AS value, CASE way WHEN 'up' THEN value >= lo WHEN 'down' THEN value <= hi WHEN 'in' THEN value BETWEEN lo AND hi END AS met FROM A"""


def declared_points(m: Model):
    value = F.when(F.col("event_id") % 4 == 0, F.lit(0.0)).otherwise(F.col("value"))
    return m.table("events").select(F.col("event_type").alias("measure_id"), (F.col("user_id") % 3).cast("string").alias("dimension"), F.col("ts").cast("timestamp").alias("ts"), value.alias("value"))


def declared(rows):
    return rows.select("measure_id", "dimension", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("value", 6).alias("value"), "met")


@query(DECLARED_SQL)
def declared_measures(spark, sf_dir):
    """Each measure by its own aggregation and window, quantiles from sketches of hours."""
    measures = streams.measures_table(spark, DECLARED_MEASURES)
    return declared(streams.declared_windows(streams.measure_parts(declared_points(Model(spark, sf_dir))), measures))


@query(DECLARED_SQL)
def stream_declared_measures(spark, sf_dir):
    """The same from a stream: hours are written when the watermark has passed them, and put together when asked for."""
    landed, checkpoint, out = files.scratch(spark, "points"), files.scratch(spark, "progress"), files.scratch(spark, "hours")
    points = declared_points(Model(spark, sf_dir))
    points.repartitionByRange(4, "ts").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(landed)
    closing = points.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("measure_id"), F.lit("").alias("dimension"), (F.col("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"), F.lit(0.0).alias("value"), F.lit(9).alias("part"))
    closing.write.mode("append").partitionBy("part").parquet(landed)
    stream = streams.files(spark, landed, points.schema, 1)
    streams.windows(streams.measure_parts(stream, late="400 days"), out, checkpoint).awaitTermination()
    return declared(streams.declared_windows(spark.read.parquet(out), streams.measures_table(spark, DECLARED_MEASURES)))


# The rest of a row of the survey, beside the query of its name.
@query("""WITH B AS (SELECT *, CAST(regexp_extract(source_uri, '([0-9]+)$', 1) AS BIGINT) + CAST(regexp_extract(target_uri, '([0-9]+)$', 1) AS BIGINT) AS k FROM L WHERE predicate IN ('extends', 'stewards'))
  SELECT source_uri, target_uri, CASE WHEN source_uri = target_uri THEN 'self-link' WHEN target_uri NOT IN (SELECT uri FROM N) THEN 'target-missing' WHEN k % 7 = 0 THEN 'pattern' END AS fault FROM B""", "L N")
def link_patterns(spark, sf_dir):
    """Links with a pattern: only the eight known ones pass, no or an empty one does."""
    m = Model(spark, sf_dir)
    digits = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    rest = (digits("source_uri") + digits("target_uri")) % 7
    pattern = F.when(rest == 0, "odd").when(rest == 1, "shared-kernel").when(rest == 2, "")
    links = m.extends.unionByName(m.stewards).withColumn("pattern", pattern)
    return joins.validate_links(links, m).select("source_uri", "target_uri", "fault")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') ELSE regexp_replace(CASE WHEN strpos(coalesce(text, ''), chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') END AS description FROM documents""")
def symbol_descriptions(spark, sf_dir):
    """What is left of a note beside its name."""
    rows = Model(spark, sf_dir).table("documents")
    label = F.when(F.col("doc_id") % 4 == 0, F.col("source"))
    return rows.select(F.col("doc_id").alias("id"), texts.symbol_description(label, F.col("text")).alias("description"))


@query("""WITH G AS (SELECT 'bm:thing:p' || p_partkey AS uri FROM part WHERE p_partkey % 5 = 0), T AS (SELECT source_uri IN (SELECT uri FROM G) OR target_uri IN (SELECT uri FROM G) AS gone FROM L)
  SELECT 'entity' AS kind, count(*) AS n FROM E WHERE uri NOT IN (SELECT uri FROM G) UNION ALL SELECT 'kept', count(*) FILTER (NOT gone) FROM T UNION ALL SELECT 'pruned', count(*) FILTER (gone) FROM T""", "E L")
def facet_removal(spark, sf_dir):
    """Every fifth part goes, one by one, with its links."""
    m = Model(spark, sf_dir)
    gone = m.parts.where("ord % 5 = 0").select("map_id", "uri")
    left, kept, pruned = versions.remove_entities(m.entities, m.links, gone)
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(left, "entity").union(count(kept, "kept")).union(count(pruned, "pruned"))


@query("""WITH S AS (SELECT doc_id, 'bm:symbol:d' || doc_id AS uri, text FROM documents), A AS (SELECT 'annotates' AS predicate, 'bm:symbol:d' || doc_id AS source_uri, 'bm:thing:p' || (doc_id % 50 + 1) AS target_uri, doc_id FROM documents)
  SELECT 'context' AS kind, 'bm:ctx:' || sha256(uri) AS uri, 'bm:ctx:n' || (doc_id % 25) AS place FROM S WHERE doc_id % 3 = 0 UNION ALL SELECT 'symbol', uri, NULL FROM S WHERE doc_id % 3 <> 0
  UNION ALL SELECT 'kept', source_uri, target_uri FROM A WHERE doc_id % 3 <> 0 UNION ALL SELECT 'pruned', source_uri, target_uri FROM A WHERE doc_id % 3 = 0""")
def bulk_contexts(spark, sf_dir):
    """Every third note becomes a context; its links go."""
    m = Model(spark, sf_dir)
    d = m.table("documents")
    links = d.select(F.lit("tpch").alias("map_id"), F.lit("annotates").alias("predicate"), uri("symbol:d", "doc_id").alias("source_uri"), F.concat(F.lit("bm:thing:p"), (F.col("doc_id") % 50 + 1).cast("string")).alias("target_uri"))
    choices = d.where("doc_id % 3 = 0").select(F.lit("tpch").alias("map_id"), uri("symbol:d", "doc_id").alias("uri"), F.concat(F.lit("bm:ctx:n"), (F.col("doc_id") % 25).cast("string")).alias("parent_uri"))
    content = string_of(field("content"))
    none = F.lit(None).cast("string")
    made, left, kept, pruned = versions.classify_as_contexts(m.symbols, links, choices, texts.symbol_name(none, content), texts.symbol_description(none, content))
    rows = made.select(F.lit("context").alias("kind"), "uri", F.col("parent_uri").alias("place")).union(left.select(F.lit("symbol"), "uri", none))
    return rows.union(kept.select(F.lit("kept"), "source_uri", "target_uri")).union(pruned.select(F.lit("pruned"), "source_uri", "target_uri"))


@query("""WITH O AS (SELECT 'event-occurrence/' || event_id AS s, event_type, ts, CASE WHEN event_id % 3 = 0 THEN 'bm:action:o' || user_id WHEN event_id % 3 = 1 THEN '' END AS who, 'measure-point/' || event_type || '/' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '-' || event_id AS m, event_id, user_id FROM events)
  SELECT s, 'rdf:type' AS p, 'bm:EventOccurrence' AS o FROM O UNION ALL SELECT s, 'instanceOf', event_type FROM O UNION ALL SELECT s, 'occurredAt', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM O UNION ALL SELECT s, 'triggeredBy', who FROM O WHERE who <> ''
  UNION ALL SELECT m, 'rdf:type', 'bm:MeasureDataPoint' FROM O UNION ALL SELECT m, 'measureOf', event_type FROM O UNION ALL SELECT m, 'value', CAST(event_id AS VARCHAR) FROM O UNION ALL SELECT m, 'timestamp', strftime(ts, '%Y-%m-%d %H:%M:%S') || '-' || event_id FROM O
  UNION ALL SELECT m, 'dimension/user', CAST(user_id % 5 AS VARCHAR) FROM O UNION ALL SELECT m, 'dimension/odd', 'yes' FROM O WHERE event_id % 2 = 1""")
def event_measure_triples(spark, sf_dir):
    """Events that happened and points that were measured, as triples."""
    events, c = Model(spark, sf_dir).table("events"), F.col
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    source = F.when(c("event_id") % 3 == 0, F.concat(F.lit("bm:action:o"), c("user_id").cast("string"))).when(c("event_id") % 3 == 1, "")
    happened = events.select(c("event_id").alias("id"), c("event_type").alias("event_id"), when.alias("occurred_at"), source.alias("source_action_id"))
    dimensions = F.map_filter(F.create_map(F.lit("user"), (c("user_id") % 5).cast("string"), F.lit("odd"), F.when(c("event_id") % 2 == 1, "yes")), lambda _, v: v.isNotNull())
    points = events.select(c("event_type").alias("measure_id"), F.concat_ws("-", when, c("event_id").cast("string")).alias("ts"), c("event_id").alias("value"), dimensions.alias("dimensions"))
    return triples.occurrence_triples(happened).unionByName(triples.measure_triples(points))


@query("""WITH S AS (SELECT 'bm:thing:p' || min(p_partkey) AS id FROM part), U AS (SELECT source_uri AS a, target_uri AS b, predicate FROM L WHERE predicate IN ('extends', 'stewards')), Y AS (SELECT a, b FROM U UNION SELECT b, a FROM U),
    W(id, depth) AS (SELECT id, 0 FROM S UNION SELECT Y.b, W.depth + 1 FROM W JOIN Y ON Y.a = W.id WHERE W.depth < 2), R AS (SELECT id, min(depth) AS depth FROM W WHERE id NOT IN (SELECT id FROM S) GROUP BY id)
  SELECT 'direct' AS kind, b AS id, predicate, 1 AS depth FROM U JOIN S ON a = id UNION ALL SELECT 'direct', a, predicate, 1 FROM U JOIN S ON b = id UNION ALL SELECT 'transitive', id, NULL, CAST(depth AS INTEGER) FROM R
  UNION ALL SELECT 'container', container_uri, NULL, CAST(count(*) AS INTEGER) FROM R JOIN E ON E.uri = R.id GROUP BY 2 UNION ALL SELECT 'total', NULL, NULL, CAST(count(*) AS INTEGER) FROM R""", "E L", True)
def impact_report(spark, sf_dir):
    """All that a part touches: direct links with their predicates, what lies two steps away, containers, the total."""
    m = Model(spark, sf_dir)
    start = m.table("part").agg(F.min("p_partkey").alias("k")).select(F.lit("tpch").alias("map_id"), uri("thing:p", "k").alias("id"))
    owners = m.entities.select("map_id", F.col("uri").alias("id"), "container_uri")
    return graph.impact_report(start, m.walks("extends", "stewards"), owners, 2)
