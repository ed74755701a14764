"""Text as data: mentions, segments, typed blocks, and blocks back to text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: @[Type:Label:Id] and @[Type:Label:Id:Context].
CANONICAL = r"@\[([^:\[\]]+):([^:\[\]]*):([^:\[\]]+)(?::([^:\[\]]+))?\]"
#: @[Name](entity:Id).
LEGACY = r"@\[([^\[\]]+)\]\(([a-zA-Z]+):([^()\s]+)\)"
_CANONICAL, _LEGACY = re.compile(CANONICAL), re.compile(LEGACY, re.ASCII)  # white space as in Java's patterns


_MENTION = {"start": pa.int32(), "token": pa.string(), "kind": pa.string(), "label": pa.string(), "id": pa.string(), "context": pa.string()}
#: Characters of texts, or mentions, whose Python objects are made at a time (one text at least).
CHARACTERS, MENTIONS = 1 << 22, 1 << 16


def _mentioned(text: str) -> Iterator[tuple]:
    """The mentions of a text, in one pass over it: both patterns side by side from left to right, a legacy match only where no
    canonical one lies in it or over it. Each match is made when it is due, so no list of a text's mentions is kept."""
    canonical, legacy = _CANONICAL.finditer(text), _LEGACY.finditer(text)
    c, old = next(canonical, None), next(legacy, None)
    while c or old:
        if old is None or c is not None and c.end() <= old.start():
            yield c.start() + 1, c.group(), c.group(1), c.group(2), c.group(3), c.group(4)
            c = next(canonical, None)
        elif c is None or c.start() >= old.end():
            yield old.start() + 1, old.group(), old.group(2), old.group(1), old.group(3), None
            old = next(legacy, None)
        else:
            old = next(legacy, None)


def _all_mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text) as batches of (key, mention's fields), for a few texts or mentions at a time."""

    def made(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), _MENTION.values(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=[batch.schema.names[0], *_MENTION])

    for batch in batches:
        at, rows, read = [], [], 0
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py()
            read += len(text)
            for row in _mentioned(text):
                at.append(k)
                rows.append(row)
                if len(rows) >= MENTIONS:
                    yield made(batch, at, rows)
                    at, rows = [], []
            if read >= CHARACTERS and rows:
                yield made(batch, at, rows)
                at, rows, read = [], [], 0
        if rows:
            yield made(batch, at, rows)


def mentions(texts: DataFrame, key: str = "uri", text: str = "content") -> DataFrame:
    """key, start (from 1), token, kind, label, id, context: canonical mentions, and legacy ones that overlap none."""
    rows = texts.where(F.col(text).contains("@[")).select(key, F.col(text).cast("string").alias(text))
    return rows.mapInArrow(_all_mentions, f"`{key}` {rows.schema[key].dataType.simpleString()}, start int, token string, kind string, label string, id string, context string")


def mention_token(kind: Column, label: Column, id_: Column, context: Column) -> Column:
    return F.concat(F.lit("@["), F.concat_ws(":", kind, label, id_, context), F.lit("]"))


def segments(texts: DataFrame, key: str = "uri", text: str = "content") -> DataFrame:
    """key, position, kind (text or mention), value: a text cut at its canonical mentions; empty pieces are left out."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(CANONICAL), F.lit(0))
    parts = F.split(F.col(text), CANONICAL, -1)
    pieces = F.flatten(F.transform(parts, lambda p, i: F.array(F.struct(F.lit("text").alias("kind"), p.alias("value")), F.struct(F.lit("mention").alias("kind"), F.get(tokens, i).alias("value")))))
    kept = F.filter(pieces, lambda p: F.coalesce(p["value"] != "", F.lit(False)))
    return texts.select(key, F.posexplode(kept).alias("position", "p")).select(key, "position", "p.*")


def blocks(texts: DataFrame, key: str = "uri", text: str = "content") -> DataFrame:
    """key, block_index, block_type, level, language, checked, text: runs of lines of one kind.

    Headings 1 to 3, rules, quotes, tasks, bullets, numbered items, fenced code, paragraphs; headings and rules never merge,
    a blank line is an empty paragraph, a fence without an end runs to the end of the text.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    order = Window.partitionBy(key).orderBy("n")
    line = F.col("line")
    fence = line.startswith("```")
    lines = lines.withColumn("_fences", F.sum(fence.cast("int")).over(order))
    inside = (F.col("_fences") % 2 == 1) | fence
    kind = (
        F.when(inside, "code")
        .when(line.rlike(r"^#{1,3} "), "heading")
        .when(line.rlike(r"^-{3,}\s*$"), "rule")
        .when(line.rlike(r"^> ?"), "quote")
        .when(line.rlike(r"^[-*] \[[ xX]\] "), "task")
        .when(line.rlike(r"^[-*] "), "bullet")
        .when(line.rlike(r"^\d+\. "), "ordered")
        .when(F.trim(line) == "", "blank")
        .otherwise("paragraph")
    )
    # An opening fence and its closing one have the counts 2k + 1 and 2k + 2: both belong to code block k.
    lines = lines.withColumn("kind", kind).withColumn("_code", F.when(F.col("kind") == "code", F.floor((F.col("_fences") + F.when(fence & (F.col("_fences") % 2 == 0), -1).otherwise(0)) / 2)))
    before = lambda c: F.lag(c).over(order)
    starts = before("kind").isNull() | F.col("kind").isin("heading", "rule", "blank") | (before("kind") != F.col("kind")) | ~before("_code").eqNullSafe(F.col("_code"))
    lines = lines.withColumn("block_index", (F.sum(starts.cast("int")).over(order) - 1).cast("int"))
    plain = (
        F.when(F.col("kind") == "heading", F.regexp_replace(line, r"^#{1,3} ", ""))
        .when(F.col("kind") == "quote", F.regexp_replace(line, r"^> ?", ""))
        .when(F.col("kind") == "task", F.regexp_replace(line, r"^[-*] \[[ xX]\] ", ""))
        .when(F.col("kind") == "bullet", F.regexp_replace(line, r"^[-*] ", ""))
        .when(F.col("kind") == "ordered", F.regexp_replace(line, r"^\d+\. ", ""))
        .when(F.col("kind").isin("rule", "blank"), "")
        .when(fence, F.lit(None))
        .otherwise(line)
    )
    checked = F.when(F.col("kind") == "task", F.when(line.rlike(r"^[-*] \[[xX]\]"), "x").otherwise("o"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(line, "^(#+)", 1)))
    language = F.when(fence & (F.col("_fences") % 2 == 1), F.nullif(F.trim(line.substr(F.lit(4), F.length(line))), F.lit("")))
    grouped = lines.select(key, "block_index", "n", "kind", plain.alias("_text"), checked.alias("_checked"), level.alias("_level"), language.alias("_language")).groupBy(key, "block_index").agg(
        F.first("kind").alias("block_type"),
        F.max("_level").alias("level"),
        F.max("_language").alias("language"),
        F.array_sort(F.collect_list(F.struct("n", "_text", "_checked"))).alias("_lines"),
    )
    texts_of = F.transform(F.filter("_lines", lambda x: x["_text"].isNotNull()), lambda x: x["_text"])
    ticks = F.array_join(F.transform("_lines", lambda x: x["_checked"]), "")
    return grouped.select(key, "block_index", F.when(F.col("block_type") == "blank", "paragraph").otherwise(F.col("block_type")).alias("block_type"), "level", "language", F.nullif(ticks, F.lit("")).alias("checked"), F.array_join(texts_of, "\n").alias("text"))


def blocks_to_text(found: DataFrame, key: str = "uri") -> DataFrame:
    """key, content: the blocks as text again; ordered lists are numbered from 1, quotes marked on every line."""
    lines = F.split("text", "\n", -1)
    kind = F.col("block_type")
    made = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")))
        .when(kind == "rule", "---")
        .when(kind == "quote", F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> "), x)), "\n"))
        .when(kind == "bullet", F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))
        .when(kind == "task", F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(F.substring(F.col("checked"), i + 1, F.lit(1)) == "x", "- [x] ").otherwise("- [ ] "), x)), "\n"))
        .when(kind == "ordered", F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n```")))
        .otherwise(F.col("text"))
    )
    grouped = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_index", made.alias("made")))).alias("b"))
    return grouped.select(key, F.array_join(F.transform("b", lambda x: x["made"]), "\n").alias("content"))


def doc_triples(found: DataFrame, said: DataFrame, key: str = "uri") -> DataFrame:
    """s, p, o of blocks (blocks()) and mentions (mentions()) of texts."""
    block = F.concat_ws("#", F.col(key), F.col("block_index").cast("string"))
    pairs = F.create_map(
        F.lit("blockIndex"), F.col("block_index").cast("string"), F.lit("blockType"), F.col("block_type"), F.lit("blockLevel"), F.col("level").cast("string"),
        F.lit("blockLanguage"), F.col("language"), F.lit("blockChecked"), F.col("checked"), F.lit("blockText"), F.nullif(F.col("text"), F.lit("")),
    )
    rows = found.select(block.alias("s"), F.explode(F.map_filter(pairs, lambda _, v: v.isNotNull())).alias("p", "o"))
    return found.select(F.col(key).alias("s"), F.lit("hasPart").alias("p"), block.alias("o")).unionByName(rows).unionByName(said.select(F.col(key).alias("s"), F.lit("mentions").alias("p"), F.col("id").alias("o")).distinct())


def item_triples(found: DataFrame, key: str = "uri") -> DataFrame:
    """s, p, o of the items of lists in blocks (blocks()): their type, what they say, whether a task is done. An item is named by
    its block and its place in it."""
    lists = found.where(F.col("block_type").isin("bullet", "ordered", "task"))
    items = lists.select(key, "block_index", "block_type", "checked", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    name = F.concat(F.col(key), F.lit("#"), F.col("block_index").cast("string"), F.lit("/"), F.col("at").cast("string"))
    task = F.col("block_type") == "task"
    pairs = F.create_map(
        F.lit("blockType"), F.when(task, "taskItem").otherwise("listItem"), F.lit("blockText"), F.nullif(F.trim("line"), F.lit("")),
        F.lit("blockChecked"), F.when(task, F.when(F.substring(F.col("checked"), F.col("at") + 1, F.lit(1)) == "x", "true").otherwise("false")),
    )
    return items.select(name.alias("s"), F.explode(F.map_filter(pairs, lambda _, v: v.isNotNull())).alias("p", "o"))


def symbol_name(label: Column, content: Column) -> Column:
    """The label, else the first line cut to 80 characters, else Untitled."""
    first = F.substring(F.get(F.split(content, "\n"), F.lit(0)), 1, 80)
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(F.trim(first), F.lit("")), F.lit("Untitled"))


def symbol_description(label: Column, content: Column) -> Column:
    """What a symbol's name leaves: all content beside a label, else the lines behind the first."""
    behind = F.regexp_replace(F.array_join(F.slice(F.split(content, "\n", -1), 2, 1 << 30), "\n"), r"^\s+|\s+$", "")
    return F.when(F.coalesce(label, F.lit("")) != "", F.coalesce(content, F.lit(""))).otherwise(F.coalesce(behind, F.lit("")))


def identity_uri(id_: Column) -> Column:
    return F.concat(F.lit("bm:identity:"), id_)


def identity_of(uri: Column) -> Column:
    return F.when(uri.startswith("bm:identity:"), F.substring(uri, 13, 1 << 20))
