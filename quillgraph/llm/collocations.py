"""Phrases that occur more often together than apart, counted by FM-indexes of shards over word ids.

Words are counted first. A task then cuts its texts into pieces, numbers the frequent words, and makes shards of SHARD words; an
infrequent word ends a piece, for no frequent phrase holds one. A shard's index is the Burrows-Wheeler transform of its
words, in the order of their contexts of MOST_WORDS words. From it alone intervals of phrases are extended by a word to
the left (the mapping from the transform to the first words), while the interval of the same rows one level up is the
phrase without its last word, the extension to the right; all intervals of a depth are extended at once, with numpy.
Phrases' counts are summed across shards.

Counts of a phrase never exceed those of its parts, so depth d + 1 extends those phrases of depth d alone that occur `least`
times over all shards. Between depths only numbers move: a phrase is a hash (of 2 ** WIDER times as many values as there are words), a task adds up its shards and
writes for each range of hashes the differences of sorted hashes and their counts, and hashes that reach `least` are set in
a bitmap of FILTER bits (its size bounds what is broadcast). Phrases that share a hash or a bit only let more through: the
last pass writes the phrases that passed, as texts, and their exact counts are summed by text.

Defined results: a null text counts as empty, a null lang as `und`; repeated rows count as often as they are there; pieces of
any length are whole (a shard that ends inside one ends with the next words as context that isn't counted); an empty table
gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import LARGE_ROWS, PARTS, materialize, meet, slices

LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Words of a shard; bits of a word's hash, and by how many bits a phrase's hash is wider than the number of words; bits of a
#: bitmap of phrases (4 MB).
SHARD, BITS, WIDER, FILTER = 1 << 19, 40, 9, 1 << 25
#: Hashes that a task adds up before it hands them on; hashes of a range, and documents whose words make one.
HELD, RANGE, DOCUMENTS = 1 << 21, 1 << 21, 20_000
#: Ends of pieces become a line feed, tabs spaces, A-Z lower case.
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 9 + b" abcdefghijklmnopqrstuvwxyz")
_INDEX = "bwt binary, own binary, words array<string>, lang_of binary, langs array<string>"
_BLOCKS = "part int, grams binary, counts binary"


def pieces_of(text: str | None) -> list[bytes]:
    """The words of a text, a line feed where a piece ends."""
    return list(filter(None, (text or "").encode().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")))


def seed_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang)


def planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32 byte by byte: all low bytes, then all next ones; bytes that are mostly 0 take next to no room."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class Sums:
    """Counts by hash, added up until there are HELD, then written by ranges of hashes."""

    def __init__(self, parts: int, bits: int) -> None:
        self.parts, self.bits, self.grams, self.counts, self.size = parts, bits, [], [], 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams.append(grams >> np.uint64(64 - self.bits))
        self.counts.append(counts.astype(np.int64))
        self.size += len(grams)

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        grams, counts = summed(np.concatenate(self.grams).astype(np.int64), np.concatenate(self.counts))
        self.grams, self.counts, self.size = [], [], 0
        width = -(-(1 << self.bits) // self.parts)
        # Counts beyond 32 bits go as several rounds of the same hash.
        while len(grams):
            ends = np.searchsorted(grams, np.arange(1, self.parts + 1) * width)
            rows, at = [], 0
            now = np.minimum(counts, 0xFFFFFFFF)
            for part, end in enumerate(ends.tolist()):
                if end > at:
                    steps = np.diff(grams[at:end], prepend=part * width)
                    rows.append((part, planes(steps & 0xFFFFFFFF) + planes(steps >> 32), planes(now[at:end])))
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "grams", "counts"])
            left = counts > now
            grams, counts = grams[left], (counts - now)[left]


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[starts], np.add.reduceat(counts, starts) if len(grams) else counts


def frequent(blocks: DataFrame, parts: int, bits: int, least: int) -> DataFrame:
    """gram: the hashes whose counts reach `least`. A range holds about RANGE hashes, whatever the table's size."""
    width = -(-(1 << bits) // parts)

    def folded(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found, numbers = [grams], [counts]
            for data, n in zip(batch.column("grams").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                low, high = data[: len(data) // 2], data[len(data) // 2 :]
                found.append(np.cumsum(from_planes(low) + (from_planes(high) << 32)) + key[0].as_py() * width)
                numbers.append(from_planes(n))
            grams, counts = summed(np.concatenate(found), np.concatenate(numbers))
        yield pa.RecordBatch.from_arrays([pa.array(grams[counts >= least])], names=["gram"])

    return blocks.groupBy("part").applyInArrow(folded, "gram bigint")


def bitmap(grams: DataFrame):
    """A bitmap of FILTER bits of the hashes, for all tasks."""
    place = F.col("gram").bitwiseAND(F.lit(FILTER - 1))
    blocks = grams.select(place.alias("p")).groupBy(F.shiftright("p", 15).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("map")).toArrow()
    bits = np.zeros(FILTER // 8, np.uint8)
    for block, piece in zip(blocks["block"].to_pylist(), blocks["map"].to_pylist(), strict=True):
        bits[4096 * block : 4096 * (block + 1)] = np.frombuffer(piece, np.uint8)
    return grams.sparkSession.sparkContext.broadcast(bits)


def passes(known: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = ((hashes >> np.uint64(64 - bits)) & np.uint64(FILTER - 1)).astype(np.int64)
    return (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def count_words(documents: DataFrame, parts: int) -> DataFrame:
    """Blocks of the hashes of words (with their languages), and per task and language how many there are (lang, total)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()
        words: dict[str, Counter] = defaultdict(Counter)
        sums = Sums(parts, BITS)

        def moved() -> None:
            for lang, some in words.items():
                seed = seed_of(lang)
                sums.add(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in some), np.uint64, len(some)), np.fromiter(some.values(), np.int64, len(some)))
            words.clear()

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=[*batch.schema.names, "lang", "total"])

        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                pieces = pieces_of(text)
                words[lang].update(pieces)
                ends = words[lang].pop(b"\n", 0)
                totals[lang] += len(pieces) - ends
            if sum(map(len, words.values())) > HELD // 8:
                moved()
            if sums.size > HELD:
                yield from map(out, sums.out())
        moved()
        yield from map(out, sums.out())
        n = len(totals)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["part", "grams", "counts", "lang", "total"])

    return _texts(documents).mapInArrow(counted, f"{_BLOCKS}, lang string, total bigint")


class _Ids(dict):
    """Numbers of a language's frequent words in a shard, shared by its languages; 0 ends a piece."""

    def __init__(self, lang: int, seed: int, shard: _Shard) -> None:
        super().__init__({b"\n": 0})
        self.lang, self.seed, self.shard = lang, seed, shard

    def __missing__(self, word: bytes) -> int:
        key = xxhash.xxh3_64_intdigest(word, self.seed)
        at = (key >> (64 - BITS)) & (FILTER - 1)
        number = 0
        if self.shard.bits[at >> 3] >> (at & 7) & 1:
            number = len(self.shard.words)
            self.shard.words.append(word)
            self.shard.lang_of.append(self.lang)
        self[word] = number
        return number


def context_order(ids: np.ndarray) -> np.ndarray:
    """Places of ids, sorted by the MOST_WORDS words from there on (round the end), by doubling: pairs, fours, one more."""

    def ranks(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = high * (int(low.max()) + 1) + low
        order = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        return rank, order

    one = ids.astype(np.int64)
    two, _ = ranks(one, np.roll(one, -1))
    four, _ = ranks(two, np.roll(two, -2))
    return ranks(four, np.roll(one, -4))[1]


class _Shard:
    """What a task holds of a shard until it is full: numbers of words, 0 behind each text, and the words' table."""

    def __init__(self, bits: bytes) -> None:
        self.bits = bits
        self.held: list[np.ndarray] = []
        self.size, self.words, self.lang_of = 0, [b"\n"], [0]
        self.ids: dict[str, _Ids] = {}

    def add(self, lang: str, pieces: list[bytes], counted: int) -> None:
        known = self.ids.get(lang)
        if known is None:
            known = self.ids[lang] = _Ids(len(self.ids), seed_of(lang), self)
        self.held.append(np.fromiter(map(known.__getitem__, pieces), np.int32))
        self.size += counted

    def end(self) -> None:
        self.held.append(np.zeros(1, np.int32))

    def index(self, context: int) -> pa.RecordBatch:
        """The index of what is held, whose last `context` words don't count."""
        self.end()
        ids = np.concatenate(self.held)
        counted = np.arange(len(ids)) < len(ids) - 1 - context
        told = (ids > 0) | np.concatenate([[True], ids[:-1] > 0])  # one end behind a piece is enough
        ids, counted = ids[told], counted[told]
        if ids[-1]:
            ids, counted = np.append(ids, 0), np.append(counted, False)
        order = context_order(ids)
        row = [planes(ids[order - 1]), np.packbits(counted[order]).tobytes(), [w.decode() for w in self.words], np.array(self.lang_of, "<i4").tobytes(), list(self.ids)]
        types = [pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["bwt", "own", "words", "lang_of", "langs"])


def indexes(documents: DataFrame, bits, size: int = SHARD) -> DataFrame:
    """The indexes of shards of `size` words, a row each: the transform, which rows count, the frequent words (bits: their
    bitmap) with their languages."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value.tobytes()
        shard = _Shard(known)
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                pieces = pieces_of(text)
                at = 0
                while at < len(pieces):
                    until = min(len(pieces), at + size - shard.size)
                    full = until - at == size - shard.size
                    ahead = pieces[until : until + MOST_WORDS - 1] if full else []
                    shard.add(lang, pieces[at:until] + ahead, until - at)
                    at = until
                    if full:
                        yield shard.index(len(ahead))
                        shard = _Shard(known)
                    else:
                        shard.end()
        if shard.held:
            yield shard.index(0)

    return _texts(documents).mapInArrow(built, _INDEX)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def levels(bwt: np.ndarray, own: np.ndarray, keys: np.ndarray, depth: int, passes: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first words, numbers of the rest at the level before, hashes, counts) of the phrases of 1 to `depth` words, those
    that pass."""
    back = np.argsort(bwt, kind="stable")  # the row whose word before is the first word of this row
    first = bwt[back]
    label = np.where(first > 0, 0, -1).astype(np.int32)
    rest = label
    hashes = np.zeros(1, np.uint64)
    for d in range(1, depth + 1):
        rows = np.flatnonzero((label >= 0) & (rest >= 0))
        if not len(rows):
            return
        word, tail = first[rows], rest[rows]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (tail[1:] != tail[:-1])])
        starts = np.flatnonzero(new)
        word, tail = word[starts], tail[starts]
        counts = np.add.reduceat(own[rows].astype(np.int64), starts)
        hashes = _mixed((hashes[tail] * np.uint64(0x9E3779B97F4A7C15)) ^ keys[word])
        good = passes(d, hashes)
        number = np.where(good, np.cumsum(good) - 1, -1).astype(np.int32)
        label = np.full(len(bwt), -1, np.int32)
        label[rows] = number[np.cumsum(new) - 1]
        rest = label[back]
        hashes = hashes[good]
        yield word[good], tail[good], hashes, counts[good]


def _known(filters: list, bits: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Words in an index are frequent; filters are for phrases of two words and more; beyond them all pass."""
    return lambda d, hashes: passes(filters[d - 2].value, hashes, bits) if 1 < d < len(filters) + 2 else np.ones(len(hashes), bool)


def _loaded(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[str]]:
    """A shard's transform, which rows count, its words' hashes, the words and their languages."""
    bwt = from_planes(batch.column("bwt")[k].as_py()).astype(np.int32)
    own = np.unpackbits(np.frombuffer(batch.column("own")[k].as_py(), np.uint8), count=len(bwt)).astype(bool)
    words, names = batch.column("words")[k].as_py(), batch.column("langs")[k].as_py()
    lang_of = np.frombuffer(batch.column("lang_of")[k].as_py(), "<i4").tolist()
    seeds = [seed_of(lang) for lang in names]
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[x]) for w, x in zip(words, lang_of, strict=True)), np.uint64, len(words))
    return bwt, own, keys, words, [names[x] for x in lang_of]


def sums_of(shards: DataFrame, filters: list, parts: int, bits: int) -> DataFrame:
    """Blocks of the phrases one word longer than the filters know: hashes and their counts over a task's shards."""
    depth = len(filters) + 2

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(parts, bits)
        for batch in batches:
            for k in range(batch.num_rows):
                for d, (_, _, hashes, counts) in enumerate(levels(*_loaded(batch, k)[:3], depth, _known(filters, bits)), 1):
                    if d == depth:
                        sums.add(hashes, counts)
                if sums.size > HELD:
                    yield from sums.out()
        yield from sums.out()

    return shards.mapInArrow(found, _BLOCKS)


def phrases(shards: DataFrame, filters: list, bits: int, parts: int, least: int) -> DataFrame:
    """lang, phrase, f: the phrases of one word, and of as many more as there are filters, that occur `least` times or more. A task
    adds up its shards by text and hands on lists, one for each range of hashes; ranges are then added up like those of
    the depths before."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = defaultdict(dict)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, some in held.items():
                texts, counts = np.array(list(some), object), np.fromiter(some.values(), np.int64, len(some))
                part = np.fromiter((xxhash.xxh3_64_intdigest(x) % parts for x in some), np.int64, len(some))
                order = np.argsort(part, kind="stable")
                own, starts = np.unique(part[order], return_index=True)
                ends = pa.array(np.append(starts, len(order)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(texts[order], pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts[order], pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([lang] * len(own), pa.string()), *lists], names=["part", "lang", "phrases", "counts"])
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                *index, words, langs = _loaded(batch, k)
                words, langs = np.array(words, object), np.array(langs, object)
                texts = np.array([""], object)
                for d, (word, tail, _, counts) in enumerate(levels(*index, len(filters) + 1, _known(filters, bits)), 1):
                    texts = words[word] + " " + texts[tail] if d > 1 else words[word]
                    for lang, text, n in zip(langs[word].tolist(), texts.tolist(), counts.tolist(), strict=True):
                        some = held[lang]
                        some[text] = some.get(text, 0) + n
                if sum(map(len, held.values())) > HELD // 4:
                    yield from out()
        yield from out()

    def folded(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for batch in batches:
            for text, n in zip(batch.column("phrases").flatten().to_pylist(), batch.column("counts").flatten().to_pylist(), strict=True):
                sums[text] = sums.get(text, 0) + n
        kept = {text: n for text, n in sums.items() if n >= least}
        yield pa.RecordBatch.from_arrays([pa.array([key[1].as_py()] * len(kept), pa.string()), pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["lang", "phrase", "f"])

    lists = shards.mapInArrow(found, "part int, lang string, phrases array<string>, counts array<bigint>")
    return lists.groupBy("part", "lang").applyInArrow(folded, "lang string, phrase string, f bigint")


def frequent_phrases(documents: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f: phrases of at most `most_words` words that occur `least` times; lang, n: occurrences of words)."""
    parts = max(1, documents.count() // DOCUMENTS)
    words = materialize(count_words(documents, parts), "words")
    totals = words.where("lang is not null").groupBy("lang").agg(F.sum("total").alias("n"))
    known = bitmap(frequent(words.where("part is not null").select("part", "grams", "counts"), parts, BITS, least))
    shards = materialize(indexes(documents, known, shard), "indexes", LARGE_ROWS)
    n = totals.agg(F.sum("n")).first()[0] or 0
    parts, bits = max(1, n // RANGE), min(56, max(32, n.bit_length() + WIDER))
    filters: list = []
    for _ in range(1, min(most_words, MOST_WORDS)):
        filters.append(bitmap(frequent(sums_of(shards, filters, parts, bits), parts, bits, least)))
    found = materialize(phrases(shards, filters, bits, parts, least), "phrases")
    for one in (known, *filters):
        one.destroy()
    return found, totals


def collocations(documents: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    known, totals = frequent_phrases(documents, least, most_words, shard)
    split = known.withColumn("w", F.split("phrase", " "))
    several = split.where("size(w) > 1")
    # A phrase inside a longer one that is as frequent lies in one with one word more that is as frequent.
    part = lambda at: F.expr(f"array_join(slice(w, {at}, size(w) - 1), ' ')").alias("phrase")
    inside = several.select("lang", part(1), F.col("f")).union(several.select("lang", part(2), F.col("f"))).distinct()
    candidates = several.join(inside, ["lang", "phrase", "f"], "left_anti").join(totals, "lang").withColumnRenamed("f", "a")

    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("rest"))
    cuts = meet(cuts, known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"], "phrase")
    cuts = meet(cuts, known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], "phrase")
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})").cast("long")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    scored = scored.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= top).drop("_part", "_k")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM (
    SELECT row_number() OVER () AS doc_id, lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) q(m) WHERE len(ws) >= m) GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM g WHERE m > 1),
inside AS (SELECT DISTINCT lang, f, unnest([array_to_string(ws[1 : m - 1], ' '), array_to_string(ws[2 : m], ' ')]) AS phrase FROM s),
c AS (SELECT s.*, unnest(range(1, m)) AS k FROM s ANTI JOIN inside USING (lang, phrase, f)),
x AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, t.n, k, CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM c JOIN t USING (lang) JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : k], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1 : c.m], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM y
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
