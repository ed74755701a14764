"""Mixture-controlled packing of documents into sequences of fixed length.

Each source is a queue of the token ids of its documents, cut into quanta of `quantum` ids. Windows (sequences of `length`
ids) are filled by deficit round-robin to target proportions: `targets` gives some sources their share of every window, the
other sources share the rest by their sizes; without targets all do. A queue is owed its share of every window in quanta;
what it is owed beyond whole quanta it gets in a later window. A queue that has run out leaves the rotation, and the others
keep their proportions to each other. Within a window the quanta of a queue follow each other, so a source has one run there.

The accounts have a closed form, so they are carried across windows and across Spark's partitions without a state: the queues
are the leaves of a binary tree; of the first g quanta that a node sends, the left half of its queues sends floor(g * a / b),
where a of the node's b quanta are theirs. Both halves' counts grow with g one by one, all queues end together, and
no queue is ever further from its share than the depth of the tree, log2 of the number of queues. The ids of a queue's last,
broken quantum follow behind all windows of whole quanta, queue by queue; what is less than a whole sequence at the end is
cut into sequences of powers of two, which need no padding.

Jobs: (1) tokenize each text once; ids are stored as two bytes each in the shared folder together with the place of the
document within its task and source; (2) add up those counts per task and source (prefix sums over one row per task and
source); (3) cut the stored ids into pieces. No text or id is shuffled unless the table of (2) has outgrown a broadcast.

Defined results: a null text counts as empty; an empty text is the one id `end_id`; repeated rows are packed each; a null
source is a source; an empty table gives no pieces; a target for a source without documents has no effect, a target of 0 has
its turn when all others have run out. Sources without a target that hold less than one id in SMALL share one queue (a
window has no whole id for them): so at most SMALL queues, whatever the number of sources.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, running_start, slices

LENGTH, END_ID, QUANTUM, SMALL, MOST_BASES = 4096, 2, 256, 4096, 500_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: Texts of these characters (ASCII and the letters of Latin-1) go through a cache of pretokens: there, lower case is one
#: character for one, composition changes nothing and the classes of the tokenizer's pattern are known.
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
#: The pretokens of word_bpe_49k.json over such texts.
_LETTERS = "a-zß-öø-ÿ"
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\x09-\x0d\x20{_LETTERS}0-9]+")
CACHED = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of texts as little-endian bytes, `width` bytes each. Pretokens are encoded by the tokenizer once and then
    remembered (the memory is emptied beyond CACHED); a text with other characters, or with the mark of a special token, goes to the
    tokenizer whole. The two ways agree (tests/llm compares them)."""

    known: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For pretokens: they are normalized and cut already, and nobody asks for their offsets.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.cache: dict[str, bytes] = {}
        # The cache knows one way of cutting words; other tokenizers get their texts whole.
        self.cut = os.path.basename(path) == "word_bpe_49k.json"

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.cut or "<|" in text or not _PLAIN.fullmatch(text):
            return self.whole(text)
        words = _PRETOKEN.findall(text.lower())
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            if len(cache) > CACHED:
                cache.clear()
            fresh = list({w for w in words if w not in cache})
            cache.update(zip(fresh, (self.pack(e.ids) for e in self.words.encode_batch_fast(fresh, add_special_tokens=False)), strict=True))
            return b"".join([cache[w] for w in words])


def tokenized(documents: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, task, place (ids of the same task and source before this document), n, ids: stored, one row a document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, places = Encoder.of(tokenizer), {}
        end, width, task = encoder.pack([end_id]), encoder.width, TaskContext.get().partitionId()
        for part in slices(batches):
            ids = [encoder.encode(text or "") + end for text in part.column(2).to_pylist()]
            n, place = [len(x) // width for x in ids], []
            for source, size in zip(part.column(1).to_pylist(), n, strict=True):
                place.append(places.get(source, 0))
                places[source] = place[-1] + size
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([task] * len(n), pa.int32()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "task", "place", "n", "ids"])

    needed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return materialize(needed.mapInArrow(rows, "doc_id bigint, source string, task int, place bigint, n bigint, ids binary"), "ids")


def phases(units: np.ndarray, shares: list[float | None]) -> np.ndarray:
    """Quanta that each queue (column) sends until the next one has run out (row). shares: of every window, or None for those
    that share the rest by their units."""
    free = np.array([x is None for x in shares], bool)
    named = np.array([x or 0.0 for x in shares])
    rest = max(0.0, 1.0 - float(named.sum()))
    weights = units.astype(float) if free.all() else np.where(free, rest * units / max(1, int(units[free].sum())), named)
    left, out = units.astype(np.int64).copy(), []
    while left.any():
        rate = np.where(left > 0, weights, 0.0)
        if not rate.any():
            rate = left.astype(float)
        time = min(n / r for n, r in zip(left.tolist(), rate.tolist(), strict=True) if r > 0)
        due = rate * time
        sent = np.where((rate > 0) & (left - due < 1), left, np.minimum(np.floor(due).astype(np.int64), left))
        out.append(sent)
        left = left - sent
    return np.array(out, np.int64).reshape(-1, len(units))


class Schedule:
    """Where the quanta of queues stand; lengths: ids of every queue."""

    def __init__(self, lengths: np.ndarray, quantum: int, length: int, shares: list[float | None] | None = None) -> None:
        self.quantum, self.window = quantum, length // quantum
        self.units = lengths // quantum
        self.total = int(self.units.sum())
        self.rests = self.total * quantum + np.cumsum(lengths % quantum) - lengths % quantum
        self.exact = np.int64 if self.total**2 < 1 << 62 else object
        sent = phases(self.units, shares or [None] * len(lengths))
        self.size = 1 << max(0, len(lengths) - 1).bit_length()
        zero = np.zeros((1, len(lengths)), np.int64)
        self.own = np.vstack([zero, np.cumsum(sent, axis=0)])  # quanta of each queue before each phase
        self.ahead = np.cumsum(self.own, axis=1) - self.own  # those of the queues before it
        self.first = self.own.sum(axis=1)
        self.sums = np.zeros((len(sent), self.size + 1), np.int64)
        self.sums[:, 1 : len(lengths) + 1] = np.cumsum(sent, axis=1)
        self.sums[:, len(lengths) + 1 :] = self.sums[:, len(lengths) : len(lengths) + 1]

    def path(self, queue: int, phase: int) -> list[tuple[int, int, bool]]:
        """From the root to the queue: quanta of the left half, of both, and whether the queue is in the right one."""
        low, high, out = 0, self.size, []
        while high - low > 1:
            mid = (low + high) // 2
            a, b = (int(self.sums[phase, x] - self.sums[phase, low]) for x in (mid, high))
            out.append((a, b, queue >= mid))
            low, high = (mid, high) if queue >= mid else (low, mid)
        return out

    def sent(self, queue: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the first x quanta, those of the queue and those of the queues before it."""
        own, ahead = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        which = np.clip(np.searchsorted(self.first, x, "right") - 1, 0, len(self.sums) - 1)
        for phase in np.unique(which).tolist():
            at = which == phase
            g, before = (x[at] - self.first[phase]).astype(self.exact), 0
            for a, b, right in self.path(queue, phase):
                left = g * a // b if b else g * 0
                before, g = (before + left, g - left) if right else (before, left)
            own[at], ahead[at] = g + self.own[phase, queue], before + self.ahead[phase, queue]
        return own, ahead

    def turn(self, queue: int, slots: np.ndarray) -> np.ndarray:
        """The place of the queue's quanta in the order of sending."""
        out = np.zeros(len(slots), np.int64)
        which = np.searchsorted(self.own[:, queue], slots, "right") - 1
        for phase in np.unique(which).tolist():
            at = which == phase
            g = (slots[at] - self.own[phase, queue]).astype(self.exact)
            for a, b, right in reversed(self.path(queue, phase)):
                g = g * b // (b - a) if right else -(-(g + 1) * b // a) - 1
            out[at] = g + self.first[phase]
        return out

    def place(self, own: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Ids before each quantum (queue own, number slots; the one behind the whole ones is the broken one)."""
        out = np.zeros(len(slots), np.int64)
        for queue in np.unique(own).tolist():
            of = own == queue
            whole = of & (slots < self.units[queue])
            out[of & ~whole] = self.rests[queue]
            if whole.any():
                first = self.turn(queue, slots[whole]) // self.window * self.window
                mine, ahead = self.sent(queue, first)
                _, then = self.sent(queue, np.minimum(first + self.window, self.total))
                out[whole] = (first + then - ahead + slots[whole] - mine) * self.quantum
        return out


def cuts(total: int, length: int) -> np.ndarray:
    """Starts of the sequences after the last whole one: powers of two, falling."""
    rest, at, out = total % length, total - total % length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append(at)
            at += 1 << bit
    return np.array(out, np.int64)


def pieces_of(starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, lengths: np.ndarray, schedule: Schedule, length: int) -> dict[str, np.ndarray]:
    """Pieces of documents that begin at `starts` of the queues `own`: document, start and length in it, sequence, offset."""
    quantum = schedule.quantum
    first, last = starts // quantum, (starts + sizes - 1) // quantum
    many = last - first + 1
    doc = np.repeat(np.arange(len(starts)), many)
    slot = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    low = np.maximum(slot * quantum, starts[doc])
    high = np.minimum((slot + 1) * quantum, (starts + sizes)[doc])
    where = schedule.place(own[doc], slot) + low - slot * quantum
    total = int(lengths.sum())
    whole, tail = total // length, cuts(total, length)
    edges = lambda p: np.where(p < whole * length, p // length, whole + np.searchsorted(tail, p, "right") - 1) if len(tail) else p // length
    size = high - low
    # A piece may go over the end of a sequence; in the tail, over several.
    ends = edges(where + size - 1) - edges(where)
    part = np.repeat(np.arange(len(doc)), ends + 1)
    step = np.arange(len(part)) - np.repeat(np.cumsum(ends + 1) - ends - 1, ends + 1)
    sequence = edges(where)[part] + step
    begin = lambda s: np.where(s <= whole, s * length, tail[np.clip(s - whole, 0, len(tail) - 1)] if len(tail) else s * length)
    left = np.maximum(where[part], begin(sequence))
    over = np.where(sequence + 1 < whole + len(tail), begin(sequence + 1), total)
    right = np.minimum((where + size)[part], over)
    doc, start = doc[part], (low - starts[doc])[part] + left - where[part]
    out = {"doc": doc, "start": start, "length": right - left, "sequence": sequence, "offset": left - begin(sequence)}
    if len(doc):  # quanta that follow each other in document and sequence are one piece
        joins = (doc[1:] == doc[:-1]) & (sequence[1:] == sequence[:-1]) & (out["start"][1:] == (out["start"] + out["length"])[:-1]) & (out["offset"][1:] == (out["offset"] + out["length"])[:-1])
        heads = np.flatnonzero(np.r_[True, ~joins])
        out = {k: np.add.reduceat(v, heads) if k == "length" else v[heads] for k, v in out.items()}
    return out


def pack(
    documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, quantum: int = QUANTUM, end_id: int = END_ID, with_ids: bool = False, targets: dict[str | None, float] | None = None, small: int = SMALL
) -> DataFrame:
    """The pieces of all documents; with_ids adds their ids (array<int>). targets: shares of every window by source."""
    if length % quantum:
        raise ValueError("a window holds whole quanta")
    tokenizer, named = tokenizer or default_tokenizer(), sorted((targets or {}).items(), key=lambda x: (x[0] is None, x[0] or ""))
    stored = tokenized(documents, tokenizer, end_id)
    sums = materialize(stored.groupBy("source", "task").agg(F.sum("n").alias("n")), "sums")
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spark = documents.sparkSession
    if named:
        wanted = spark.createDataFrame([(name, float(share)) for name, share in named], "name string, share double")
        by_source = by_source.join(F.broadcast(wanted), by_source["source"].eqNullSafe(wanted["name"]), "left").drop("name")  # as many rows as targets
    else:
        by_source = by_source.withColumn("share", F.lit(None).cast("double"))
    large = by_source.where(F.col("share").isNotNull() | (F.col("n") * small >= total)).orderBy(F.col("source").asc_nulls_last()).collect()  # at most `small` and the targets
    rest = total - sum(row["n"] for row in large)
    lengths = np.array([row["n"] for row in large] + [rest] * (rest > 0), np.int64)
    shares = [row["share"] for row in large] + [None] * (rest > 0)
    queues = spark.createDataFrame([(row["source"], k) for k, row in enumerate(large)], "_name string, queue int")
    placed = sums.join(F.broadcast(queues), sums["source"].eqNullSafe(queues["_name"]), "left").select("source", "task", "n", F.coalesce("queue", F.lit(len(large))).alias("queue"))
    bases = running_start(placed, "queue", "n", ["task", "source"], "at").select(F.col("source").alias("_source"), F.col("task").alias("_task"), "queue", "at")
    bases = materialize(bases, "bases")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, schedule = Encoder.of(tokenizer).width, Schedule(lengths, quantum, length, shares)
        for batch in slices(batches):
            own, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3))
            got = pieces_of(batch.column(2).to_numpy(zero_copy_only=False), sizes, own, lengths, schedule, length)
            ids = [np.frombuffer(x, f"<u{width}").astype("<u4") for x in batch.column(4).to_pylist()]
            parts = [ids[d][s : s + n] for d, s, n in zip(got["doc"].tolist(), got["start"].tolist(), got["length"].tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(got["doc"])), pa.array(got["start"]), pa.array(got["length"]), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(sizes[got["doc"]]), pa.array(got["sequence"]), pa.array(got["offset"])]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

    if bases.count() <= MOST_BASES:  # one row per task and source; beyond that, the join shuffles the ids
        bases = F.broadcast(bases)
    found = stored.join(bases, stored["source"].eqNullSafe(bases["_source"]) & (stored["task"] == bases["_task"]))
    ready = found.select("doc_id", "queue", (F.col("at") + F.col("place")).alias("start"), "n", "ids")
    return ready.mapInArrow(rows, PIECES + ", ids array<int>" * with_ids)
