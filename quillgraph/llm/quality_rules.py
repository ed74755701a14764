"""Quality rules as a ledger of bits.

Every rule is measured once per document; the ledger keeps the measurements and one failure bit per rule. A policy is a
versioned mask over those bits: applying another version, or leaving one rule out (ablation), is a bitwise operation on
the ledger and never reads a text again.

Measurements: words are maximal runs of non-white-space (ASCII white space); word_chars their code points; n_symbols the
characters of [#*$%&|<>]; n_dup_lines the lines with a word that equal an earlier line; n_repeat_words the words inside
a three-word window found twice or more in the same text, first occurrence included; n_lines the lines with a word; n_capitals the letters A-Z.

Defined results: a null or empty text has no words (all measurements 0) and fails the base rules; repeated rows give
repeated rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE, slices

SYMBOLS = "#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint"

#: Bit, name, failure condition over the measurements. Bits never change their meaning; new rules get new bits.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > word_chars"),
    (3, "duplicate_lines", "n_dup_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    (4, "long_words", "word_chars > 20 * n_words and n_words > 0"),
    (5, "short_words", "word_chars < 2 * n_words"),
    (6, "capitals", "10 * n_capitals > 4 * word_chars"),
)
#: Version -> names of the rules that it enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words", "capitals"),
}


def mask(version: str) -> int:
    return sum(1 << bit for bit, name, _ in RULES if name in POLICIES[version])


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # else three numbers fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= twice
    return int(covered.sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for batch in slices(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            raw = text.encode()
            words = raw.split()
            lines = [line for line in text.split("\n") if line.strip(SPACE)]
            chars = len(text) - sum(text.count(c) for c in SPACE)
            rows.append((len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(raw) - len(raw.translate(None, CAPITALS))))
        columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)


def failures() -> Column:
    """The failure bits as a Column over the measurements."""
    bits = F.lit(0).cast("long")
    for bit, _, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(documents: DataFrame) -> DataFrame:
    """doc_id, the measurements, failed_bits: one row per document, no shuffle."""
    needed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return needed.mapInArrow(_measure, MEASURES).withColumn("failed_bits", failures())


def apply_policy(entries: DataFrame, version: str = "v1") -> DataFrame:
    """base_failed and kept by a policy version."""
    fails = lambda v: F.col("failed_bits").bitwiseAND(F.lit(mask(v)).cast("long")) != 0
    return entries.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(version))


def ablations(entries: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents failing it, documents failing it alone (they would stay without it), and the
    documents that the whole policy keeps. One aggregation to as many rows as there are distinct bit patterns comes first,
    so what is left is bounded by 2 ** rules."""
    whole = mask(version)
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name, _ in RULES if name in POLICIES[version]])
    one = patterns.withColumn("r", F.explode(rules))
    hits = one["bits"].bitwiseAND(one["r.bit"]) != 0
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hits, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept_by_all"),
    )
