"""Dimension tables of the vocabulary: a few dozen rows each, so joins with them are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Entity classes with their facet keys.
CLASSES = {
    "Context": None, "Thing": "things", "Persona": "personas", "Action": "actions", "Workflow": "workflows", "Interface": "interfaces",
    "Event": "events", "Measure": "measures", "Port": "ports", "Function": "functions", "DataSource": "dataSources", "Pipeline": "pipelines",
    "Symbol": "symbols", "WorkflowStep": None, "ThingState": None,
}
FACETS = {key: name for name, key in CLASSES.items() if key and name != "Symbol"}

_ALL = "Context Thing Persona Port Action Workflow Interface Event Measure"
_CORE = "Thing Persona Action Workflow Interface Event Measure"
# Predicates with domain, range and whether they are structural.
PREDICATES: tuple[tuple[str, str, str, bool], ...] = (
    ("valueStream", "Context Port", "Context Port", False),
    ("performs", "Persona", "Action", False),
    ("stewards", "Persona", "Thing Context Workflow Port", False),
    ("observes", "Persona", "Event Measure Port", False),
    ("uses", "Persona", "Interface", False),
    ("reads", "Action", "Thing", False),
    ("writes", "Action", "Thing", False),
    ("emits", "Action", "Event", False),
    ("exposes", "Interface", "Action", False),
    ("displays", "Interface", "Thing Measure", False),
    ("measures", "Measure", "Thing Action Workflow Event Context Port", False),
    ("derivedFrom", "Measure", "Measure", False),
    ("owns", "Thing", "Thing", False),
    ("references", "Thing", "Thing", False),
    ("step:action", "WorkflowStep", "Action", False),
    ("step:performer", "WorkflowStep", "Persona", False),
    ("step:interface", "WorkflowStep", "Interface", False),
    ("triggers", "Event Action Port", "Workflow Action", False),
    ("collaboratesWith", "Persona", "Persona", False),
    ("delegatesTo", "Persona", "Persona", False),
    ("invokes", "Action Workflow", "Action Workflow", False),
    ("causedBy", "Event", "Event", False),
    ("computedFrom", "Measure", "Event", False),
    ("notifies", "Event", "Persona", False),
    ("dependsOn", "Context Action Workflow Interface", "Context Action Thing Interface Event Measure", False),
    ("flowsTo", "Thing Event Action", "Context Persona Interface Action", False),
    ("implements", "Action Workflow Interface", "Action Port", False),
    ("extends", "Thing Action Context Persona", "Thing Action Context Persona", False),
    ("produces", "Action Workflow Context Port", "Thing Event Measure", False),
    ("consumes", "Action Workflow Persona Context Port", "Thing Event Measure", False),
    ("sameConceptAs", _CORE, _CORE, False),
    ("custom", "Thing Context Action Workflow Interface Event Measure Persona Symbol", "Thing Context Action Workflow Interface Event Measure Persona Symbol", False),
    ("annotates", "Symbol Interface", _ALL + " Symbol", False),
    ("documents", "Symbol", _ALL, False),
    ("composes", "Interface", "Interface", False),
    ("derivedPayloadFrom", "Event Interface", "Thing", True),
    ("hasTag", "Context " + _CORE + " Symbol", "Context " + _CORE + " Symbol", True),
    ("childOf", "Context", "Context", True),
    ("mentions", "Symbol", _ALL + " Symbol", True),
    ("memberOf", _CORE + " Symbol", "Context", True),
    ("workflow:involvesPersona", "Workflow", "Persona", True),
    ("workflow:involvesAction", "Workflow", "Action", True),
    ("state:transitionsTo", "ThingState", "ThingState", True),
    ("state:memberOf", "ThingState", "Thing", True),
    ("inheritedAttribute", "Thing", "Thing", True),
    ("computes", "Function", "Thing", False),
    ("calls", "Function Action Interface Measure Workflow", "Function", False),
    ("boundTo", "DataSource", "Port", False),
    ("pullsFrom", "Pipeline", "DataSource", False),
    ("pushesTo", "Pipeline", "DataSource", False),
    ("populates", "Pipeline", "Thing", False),
)
# Predicates whose absence is a gap (predicate, direction, only for this class or for the whole domain or range).
DEFAULT_RULES = (
    ("performs", "outgoing", None), ("performs", "incoming", None), ("uses", "incoming", None), ("reads", "outgoing", None), ("emits", "outgoing", None),
    ("exposes", "outgoing", None), ("measures", "outgoing", None), ("triggers", "incoming", "Workflow"),
)

# Classes that can have instances, and those whose instances never change.
INSTANTIABLE = ("Thing", "Persona", "Event", "Measure", "Workflow", "Action")
IMMUTABLE = ("Event", "Measure")
# Commands on runtime data that stay on their device; all others are shared.
DEVICE_LOCAL = ("pipelineRun:start", "pipelineRun:progress", "replayPoint:create", "simRun:start", "simRun:snapshot")
# What predicates are called in business, from the source's side and from the target's.
PREDICATE_LABELS = {
    "valueStream": ("sends value to", "receives value from"), "performs": ("does", "done by"), "stewards": ("is responsible for", "responsibility of"), "observes": ("watches", "watched by"),
    "uses": ("uses", "used by"), "reads": ("uses data from", "data used by"), "writes": ("changes", "changed by"), "emits": ("produces", "produced by"), "exposes": ("offers", "offered by"),
    "displays": ("shows", "shown by"), "measures": ("tracks", "tracked by"), "derivedFrom": ("is based on", "feeds into"), "owns": ("contains", "contained by"), "references": ("relates to", "related to"),
    "triggers": ("starts", "started by"), "collaboratesWith": ("works with", "works with"), "delegatesTo": ("assigns work to", "receives work from"), "invokes": ("calls", "called by"),
    "causedBy": ("resulted from", "led to"), "computedFrom": ("is calculated from", "contributes to"), "notifies": ("alerts", "alerted by"), "dependsOn": ("requires", "required by"),
    "flowsTo": ("sends to", "receives from"), "implements": ("realizes", "realized by"), "extends": ("specializes", "specialized by"), "produces": ("creates", "created by"), "consumes": ("takes from", "supplied by"),
    "sameConceptAs": ("also known as", "also known as"), "custom": ("relates to", "related to"), "annotates": ("explains", "explained by"), "documents": ("is a doc for", "has documentation"),
    "composes": ("contains", "contained by"), "computes": ("computes", "computed by"), "calls": ("calls", "called by"), "boundTo": ("bound to", "binds"), "pullsFrom": ("pulls from", "feeds"),
    "pushesTo": ("pushes to", "pushed by"), "populates": ("populates", "populated by"),
}
# Commands on runtime data. turn: open (gives the whole record), set (gives fields), status (stands for a status),
# delete, free (no record). event: what an accepted one makes known. stamp: the field that takes its time. inverse: what undoes it.
RUNTIME_COMMANDS = {
    "instance:upsert": {"turn": "open", "event": "instance.upserted", "inverse": "instance:delete"},
    "instance:update": {"turn": "set", "event": "instance.updated", "stamp": "updatedAt", "inverse": "instance:update"},
    "instance:delete": {"turn": "delete", "event": "instance.deleted", "inverse": "instance:upsert"},
    "instance:link": {"turn": "free", "event": "instance.linked", "inverse": "instance:unlink"},
    "instance:unlink": {"turn": "free", "event": "instance.unlinked", "inverse": "instance:link"},
    "pipelineRun:start": {"turn": "open", "event": "pipelineRun.started", "inverse": "pipelineRun:cancel"},
    "pipelineRun:progress": {"turn": "set", "inverse": "pipelineRun:progress"},
    "pipelineRun:complete": {"turn": "set", "event": "pipelineRun.completed", "stamp": "completedAt", "inverse": "pipelineRun:complete"},
    "pipelineRun:cancel": {"turn": "status", "event": "pipelineRun.cancelled", "status": "cancelled", "stamp": "completedAt", "inverse": "pipelineRun:start"},
    "retry:enqueue": {"turn": "open", "event": "retry.enqueued", "inverse": "retry:drop"},
    "retry:resolve": {"turn": "status", "event": "retry.resolved", "status": "resolved", "inverse": "retry:enqueue"},
    "retry:drop": {"turn": "status", "event": "retry.dropped", "status": "dropped", "inverse": "retry:enqueue"},
    "suppression:add": {"turn": "open", "event": "suppression.added", "inverse": "suppression:lift"},
    "suppression:lift": {"turn": "status", "event": "suppression.lifted", "status": "lifted", "stamp": "liftedAt", "inverse": "suppression:add"},
    "replayPoint:create": {"turn": "open", "event": "replayPoint.created", "inverse": "replayPoint:abort"},
    "replayPoint:complete": {"turn": "status", "event": "replayPoint.completed", "status": "completed", "stamp": "completedAt", "inverse": "replayPoint:create"},
    "replayPoint:abort": {"turn": "status", "event": "replayPoint.aborted", "status": "aborted", "stamp": "completedAt", "inverse": "replayPoint:create"},
    "deployment:record": {"turn": "open", "event": "deployment.recorded", "inverse": "deployment:retract"},
    "deployment:update": {"turn": "set", "event": "deployment.updated", "inverse": "deployment:update"},
    "deployment:retract": {"turn": "status", "event": "deployment.retracted", "status": "retracted", "inverse": "deployment:record"},
    "simRun:start": {"turn": "open", "event": "simRun.started", "inverse": "simRun:discard"},
    "simRun:snapshot": {"turn": "set", "inverse": "simRun:snapshot"},
    "simRun:complete": {"turn": "status", "event": "simRun.completed", "status": "completed", "stamp": "completedAt", "inverse": "simRun:start"},
    "simRun:discard": {"turn": "status", "event": "simRun.discarded", "status": "discarded", "stamp": "completedAt", "inverse": "simRun:start"},
    "writebackQueue:enqueue": {"turn": "open", "event": "writeback.enqueued", "inverse": "writebackQueue:drop"},
    "writebackQueue:ack": {"turn": "status", "event": "writeback.acked", "status": "acked", "inverse": "writebackQueue:enqueue"},
    "writebackQueue:fail": {"turn": "status", "event": "writeback.failed", "status": "failed", "stamp": "lastAttemptAt", "inverse": "writebackQueue:enqueue"},
    "writebackQueue:drop": {"turn": "status", "event": "writeback.dropped", "status": "dropped", "inverse": "writebackQueue:enqueue"},
}
# Fields of runtime records that a command after the opening one may set.
RUNTIME_FIELDS = (
    "name", "description", "tags", "data", "externalId", "sourceUri", "createdAt", "updatedAt", "status", "completedAt", "recordsProcessed", "recordsFailed", "error", "liftedAt",
    "modelVersion", "target", "environment", "deployedAt", "previousDeploymentUri", "snapshotUri", "lastAttemptAt", "lastError",
)
# Prefixes of commands on runtime data.
RUNTIME_PREFIXES = ("instance:", "pipelineRun:", "retry:", "suppression:", "replayPoint:", "deployment:", "simRun:", "writebackQueue:")

# Datatypes and the Spark types of their columns.
DATATYPES = {
    "text": "string", "identifier": "string", "email": "string", "uri": "string", "markdown": "string", "richDoc": "string", "integer": "bigint",
    "decimal": "double", "percentage": "double", "money": "struct<value: double, currencyCode: string>", "quantity": "struct<value: double, unit: string>",
    "date": "date", "dateTime": "timestamp", "time": "string", "duration": "string", "boolean": "boolean", "reference": "string", "enum": "string",
    "list": "array<string>",
}
# Built-in value types as (regex, smallest, largest, shortest, longest).
VALUE_TYPES = {
    "email": (r"^[^@]+@[^@]+\.[^@]+$", None, None, None, None),
    "url": ("^https?://", None, None, None, None),
    "phone": (r"^\+?[0-9\s\-()]+$", None, None, None, None),
    "country-code": ("^[A-Z]{2}$", None, None, 2, 2),
    "currency-code": ("^[A-Z]{3}$", None, None, 3, 3),
    "hex-color": ("^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$", None, None, None, None),
    "slug": ("^[a-z0-9]+(-[a-z0-9]+)*$", None, None, None, None),
    "percentage-0-100": (None, 0.0, 100.0, None, None),
    "positive-integer": (None, 0.0, None, None, None),
    "rating-5": (None, 1.0, 5.0, None, None),
}


def predicates(spark: SparkSession) -> DataFrame:
    """predicate, domain, range, structural."""
    rows = [(p, d.split(), r.split(), s) for p, d, r, s in PREDICATES]
    return spark.createDataFrame(rows, "predicate string, domain array<string>, range array<string>, structural boolean").coalesce(1)


def default_rules(spark: SparkSession) -> DataFrame:
    """predicate, direction, classes: the classes whose entities need such a link."""
    ends = {p: (d.split(), r.split()) for p, d, r, _ in PREDICATES}
    rows = [(p, way, [only] if only else ends[p][way == "incoming"]) for p, way, only in DEFAULT_RULES]
    return spark.createDataFrame(rows, "predicate string, direction string, classes array<string>").coalesce(1)
