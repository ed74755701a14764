"""Removal of repeated passages by overlapping windows of three lines.

The lines of a text that hold a word, trimmed of ASCII white space, are numbered. Every run of three consecutive lines is
a window; a run of one or two lines is a window too if it has more than `long_words` words (a passage of that length
counts however few line breaks it has), and a text of fewer than three lines is one window as a whole if it has at least
`short_words` words. Windows are hashed to 128 bits. A window that occurs again, at a later (doc_id, row, position), is a
repeat; the lines of a text covered by its repeats are merged and removed. The first occurrence stays: where a window
repeats itself within its own first occurrence (a line again and again), only what lies behind that is covered.

Defined results: a null text stays null, an empty one empty; a text all of whose lines are removed becomes empty; blank
lines and line breaks between kept lines stay as they are; rows of one doc_id with different texts are separate texts, rows
equal in doc_id and text are one text and fare alike; null doc_ids come last; all other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import SPACE, materialize, meet, parts_of, slices

LONG_WORDS, SHORT_WORDS, WINDOW = 50, 10, 3
_ID, _ROW, _TEXT = "_qg_id", "_qg_row", "_qg_text"


def _row(documents: DataFrame) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text", *[c for c in documents.columns if c in ("lang", "source", "n_chars")])


def _lines(documents: DataFrame) -> DataFrame:
    """_qg_id, _qg_row, lines array<struct<n, line, words>>: the lines with a word and their numbers in the text."""
    kept = f"""filter(transform(split(text, '\\n', -1), (x, i) -> named_struct('n', i, 'line', trim(BOTH '{SPACE}' FROM x))), l -> l.line != '')"""
    return documents.select(
        F.col("doc_id").cast("long").alias(_ID),
        _row(documents).alias(_ROW),
        F.expr(kept).alias("lines"),
    )


def windows(documents: DataFrame, long_words: int = LONG_WORDS, short_words: int = SHORT_WORDS) -> DataFrame:
    """_qg_id, _qg_row, at (index of the first line), width, h1, h2, first_n, n_lines: the windows of every text."""
    counted = _lines(documents).withColumn("lines", F.expr("transform(lines, l -> named_struct('n', l.n, 'line', l.line, 'words', regexp_count(l.line, '[^\\\\x20\\\\x09-\\\\x0D]+')))"))
    spans = f"""filter(flatten(transform(sequence(0, size(lines) - 1), i -> array(
        if(i + 2 < size(lines), named_struct('at', i, 'width', 3, 'x', concat_ws('\\n', lines[i].line, lines[i + 1].line, lines[i + 2].line)), null),
        if(i + 1 < size(lines) and (lines[i].words + lines[i + 1].words > {long_words} or size(lines) = 2 and lines[0].words + lines[1].words >= {short_words}), named_struct('at', i, 'width', 2, 'x', concat_ws('\\n', lines[i].line, lines[i + 1].line)), null),
        if(lines[i].words > {long_words} or size(lines) = 1 and lines[0].words >= {short_words}, named_struct('at', i, 'width', 1, 'x', lines[i].line), null)))), w -> w is not null)"""
    hashed = f"transform({spans}, w -> named_struct('at', w.at, 'width', w.width, 'h1', xxhash64(w.x), 'h2', xxhash64(w.width, w.x)))"
    return counted.where("size(lines) > 0").select(_ID, _ROW, F.explode(F.expr(hashed)).alias("w")).select(_ID, _ROW, "w.*")


def repeats(found: DataFrame) -> DataFrame:
    """_qg_id, _qg_row, low, high: the lines covered by windows that are not the first of their kind. Counts and first places are partial sums before the shuffle; the
    windows meet them in parts by document, so a kind that a third of all texts hold is spread over tasks."""
    place = F.struct(F.col(_ID).isNull().alias("late"), F.col(_ID).alias("i"), F.col(_ROW).alias("r"), F.col("at").alias("a"))
    kinds = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"), parts_of(_ID)).where("times > 1").drop("times")
    joined = meet(found, kinds, ["h1", "h2"], _ID)
    own = F.col(_ID).eqNullSafe(F.col("first.i")) & (F.col(_ROW) == F.col("first.r"))
    behind = F.when(own, F.greatest("at", F.col("first.a") + F.col("width"))).otherwise(F.col("at"))
    return joined.where(~place.eqNullSafe(F.col("first"))).select(_ID, _ROW, behind.alias("low"), (F.col("at") + F.col("width") - 1).alias("high"))


def dedup_lines(documents: DataFrame, long_words: int = LONG_WORDS, short_words: int = SHORT_WORDS) -> DataFrame:
    """documents with repeated passages removed, in the same columns, n_chars (if there is one) counted anew, then
    _n_lines (lines with a word before) and _n_removed."""
    found = materialize(windows(documents, long_words, short_words), "windows")
    covered = repeats(found).select(_ID, _ROW, F.explode(F.expr("sequence(low, high)")).alias("line"))
    gone = covered.groupBy(_ID, _ROW).agg(F.collect_set("line").alias("_qg_gone"))
    keyed = documents.withColumns({_ID: F.col("doc_id").cast("long"), _ROW: _row(documents)})
    gone = gone.select(F.col(_ID).alias("_qg_k"), F.col(_ROW).alias("_qg_r"), "_qg_gone")
    joined = keyed.join(gone, keyed[_ID].eqNullSafe(gone["_qg_k"]) & (keyed[_ROW] == gone["_qg_r"]), "left")
    return _rebuild(joined, documents)


def _rebuild(joined: DataFrame, documents: DataFrame) -> DataFrame:
    """Texts without their removed lines: each line's number is the count of lines with a word up to it, by one pass over
    the text in Arrow batches (a fold with a growing array in SQL would copy the array for every line)."""
    columns = documents.columns
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    schema = T.StructType([*documents.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_removed", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts, removed = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                drop, out, n = set(gone or ()), [], 0
                for part in (text or "").split("\n"):
                    if part.strip(SPACE):
                        if n not in drop:
                            out.append(part)
                        n += 1
                    else:
                        out.append(part)
                if drop:
                    text = "\n".join(out) if n > len(drop) else ""
                texts.append(text)
                counts.append(n)
                removed.append(len(drop))
            done = [batch.column(k) for k in range(len(columns))]
            done[at] = pa.array(texts, pa.string())
            if chars is not None:
                done[chars] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(batch.column(chars).type)
            yield pa.RecordBatch.from_arrays([*done, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, "_n_lines", "_n_removed"])

    return joined.select(*[joined[c] for c in columns], "_qg_gone").mapInArrow(rows, schema)
