"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions only.

Two texts are equal when they are identical after every ASCII white space character is deleted; the SHA-256 of what is left
stands for them. Pass one sets HASHES bits of a blocked Bloom filter for every row (all bits of a row lie in one block of
BLOCK bits) and counts, with partial sums, how many rows set each bit: only bit numbers move. The bits that two or more rows
set are the filter. Pass two asks it for every row: a row with a bit of its own is the only one of its text and passes
straight through; only the others, possibly repeated, are shuffled and grouped by their hash.

The filter grows with the rows (BITS bits a row) up to MOST_BLOCKS blocks of 4 KB, 128 MB, the bound of what is broadcast;
in a larger table it is as large and lets more rows through to the grouping, which decides alone: results never depend on it.
A text that a third of all rows hold is a row per task in all sums and meets its group in a salted join.

Defined results: a null text counts as empty and equals blank ones; of equal texts the row with the most code points in the
original text stays, then the smallest doc_id, a null doc_id last; of rows equal in doc_id and text one stays, the others
don't; an empty table gives an empty one; other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, meet, parts_of

#: Bits a row and bits set by a row, bits of a block (those of a bitmap of Spark's bitmap functions), most blocks.
BITS, HASHES, BLOCK, MOST_BLOCKS = 16, 3, 32768, 1 << 15
_ID, _ROW, _HASH, _CHARS, _N = "_qg_id", "_qg_row", "_qg_hash", "_qg_chars", "_qg_n"


def keyed(documents: DataFrame) -> DataFrame:
    """documents with _qg_id, _qg_hash (of the text without white space) and _qg_chars (code points of the text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    return documents.withColumns({_ID: F.col("doc_id").cast("long"), _HASH: F.sha2(bare, 256), _CHARS: F.char_length(text)})


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(_HASH)), F.lit(blocks)).alias("_qg_block")


def _bits() -> list[Column]:
    """Places of a row's bits in its block: 15 bits each of another hash."""
    own = F.xxhash64(F.lit(1), F.col(_HASH))
    return [F.shiftrightunsigned(own, 15 * k).bitwiseAND(F.lit(BLOCK - 1)) for k in range(HASHES)]


def blocks_for(rows: int) -> int:
    return max(1, min(MOST_BLOCKS, math.ceil(rows * BITS / BLOCK)))


def repeated_bits(rows: DataFrame, blocks: int) -> DataFrame:
    """_qg_block, _qg_map: for each block the bitmap of those bits that two or more rows set."""
    place = F.explode(F.array(*[_block(blocks) * BLOCK + bit for bit in _bits()])).alias("place")
    twice = rows.select(place).groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy(F.shiftright("place", 15).alias("_qg_block")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(BLOCK - 1))).alias("_qg_map"))


def maybe_repeated(rows: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """rows with _qg_maybe: false only where no other row has the same hash. Rows stay where they are."""
    found = rows.withColumn("_qg_block", _block(blocks)).join(F.broadcast(bits), "_qg_block", "left")
    is_set = F.lit(True)
    for bit in _bits():
        byte = F.conv(F.hex(F.substring(F.col("_qg_map"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = is_set & (F.bit_get(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return found.withColumn("_qg_maybe", F.coalesce(is_set, F.lit(False))).drop("_qg_block", "_qg_map")


def groups(rows: DataFrame) -> DataFrame:
    """_qg_hash, stay (id, chars, row, n: the row that stays and how often that row is there), size: one row per text. Rows
    are summed per (text, id, length) first, within tasks and then across them."""
    alike = rows.groupBy(_HASH, _ID, _CHARS).agg(F.count(F.lit(1)).alias(_N), F.min(_ROW).alias(_ROW), parts_of(_ROW))
    best = F.struct((-F.col(_CHARS)).alias("less"), F.col(_ID).isNull().alias("late"), F.col(_ID).alias("id"), F.col(_CHARS).alias("chars"), F.col(_ROW).alias("row"), F.col(_N).alias("n"))
    return alike.groupBy(_HASH).agg(F.min(best).alias("stay"), F.sum(_N).alias("size"), F.expr("bit_or(_bits)").alias("_bits"))


def _filter(keys: DataFrame) -> tuple[DataFrame, int]:
    blocks = blocks_for(keys.count())
    return materialize(repeated_bits(keys, blocks), "bits"), blocks


def mark(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of documents."""
    keys = keyed(documents.select("doc_id", "text")).select(_ID, _HASH, _CHARS).withColumn(_ROW, F.monotonically_increasing_id())
    keys = materialize(keys, "keys")
    bits, blocks = _filter(keys)
    flagged = maybe_repeated(keys, bits, blocks)
    alone = flagged.where("not _qg_maybe").select(F.col(_ID).alias("doc_id"), F.col(_ID).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col(_HASH).alias("text_sha256"))
    again = flagged.where("_qg_maybe")
    met = meet(again, groups(again), [_HASH], _ROW)
    kept = F.col(_ROW) == F.col("stay.row")
    return alone.unionByName(met.select(F.col(_ID).alias("doc_id"), F.col("stay.id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col(_HASH).alias("text_sha256")))


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay, all columns as they were; texts of rows that the filter calls single aren't shuffled."""
    columns = documents.columns
    keys = materialize(keyed(documents.select("doc_id", "text")).select(_ID, _HASH, _CHARS, F.lit(0).cast("long").alias(_ROW)), "keys")
    bits, blocks = _filter(keys)
    chosen = groups(maybe_repeated(keys, bits, blocks).where("_qg_maybe"))
    # The row that stays is known by its hash, id and length; where several rows are alike in these, one of them is taken.
    chosen = chosen.select(F.col(_HASH), F.col("stay.id").alias("_qg_stay"), F.col("stay.chars").alias("_qg_long"), F.col("stay.n").alias(_N))
    flagged = maybe_repeated(keyed(documents), bits, blocks)
    again = flagged.where("_qg_maybe").withColumn("_qg_by", F.xxhash64(_ID, _CHARS))
    stays = meet(again, chosen, [_HASH], "_qg_by").where(F.col(_ID).eqNullSafe(F.col("_qg_stay")) & (F.col(_CHARS) == F.col("_qg_long")))
    one = stays.where(F.col(_N) == 1).select(*columns).unionByName(stays.where(F.col(_N) > 1).dropDuplicates([_HASH]).select(*columns))
    return flagged.where("not _qg_maybe").select(*columns).unionByName(one)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (
  SELECT doc_id, h, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
  FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, h AS text_sha256 FROM g
"""
