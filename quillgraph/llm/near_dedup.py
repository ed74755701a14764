"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts gives each document the number of its distinct five-word shingles, a 128-bit key of its word
   sequence, `BANDS` band keys over groups of `ROWS` minima, and a signature that retains the low BITS bits of each of the
   `HASHES` minima, packed into longs. Equal word sequences are one class; from here on only the class's first document
   (smallest doc_id) takes part.
2. Candidates: documents that share a band key. A bucket's members are paired with its smallest document only (a star).
   A pair stays if its signatures agree: with b retained bits two different minima agree by chance with probability
   2 ** -b, so the similarity is estimated as (agreement - 2 ** -b) / (1 - 2 ** -b), by bit counts over the exclusive or.
   The bound lies six standard deviations under the threshold.
3. Candidate pairs are confirmed on their full shingle sets: 100 * intersection >= threshold * union.
4. Connected components of the confirmed links. Where a star's other members lie in several components, members of one
   component are compared with those of others, in blocks of `BLOCK` by `BLOCK` members: first their signatures, then the
   full sets of those members that have a partner. No pair leaves a block; what leaves it are links that join components,
   fewer than it has members. So a link is lost only if its documents share no band key (under 1e-6 at the threshold),
   however large a group is.

Joins on a hub, a bucket, a class or a label, any of which may be that of very many rows, are salted (common.meet).

Defined results: words are runs of non-white-space (ASCII), A-Z in lower case; a text of one to four words has one shingle,
its whole sequence; a null text or one without words has the empty set and is linked with nothing; repeated rows give
repeated rows; a null doc_id takes part in no link and has a null component; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, meet, parts_of, slices

SHINGLE, THRESHOLD = 5, 85
BANDS, ROWS, BITS = 25, 5, 2
HASHES = 128
LONGS = HASHES * BITS // 64
#: Deviations of the estimate that a candidate may lie under the threshold.
DEVIATIONS = 6
#: Members in a block; bits of the bitmap of wanted ids (16 MB).
BLOCK, MOST_BITS = 512, 1 << 27

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.random.default_rng(5).integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_draw = np.random.default_rng(11)
_FACTORS = _draw.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_ADDENDS = _draw.integers(0, 1 << 32, HASHES, np.uint32)
_BAND_FACTORS = _draw.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Word -> 64-bit hash, remembered for at most 200,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        made = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return made


_hash_of = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_UPPER).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n, known = len(words), _hash_of
    if not n:
        return np.array([], np.uint64)
    ids = np.fromiter((known[w] for w in words), np.uint64, n)
    size = min(n, SHINGLE)
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total += ids[k : n - size + 1 + k] * _PLACES[k]
    return np.unique(mix(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima (uint32) of a non-empty set under multiply-add permutations of its folded hashes."""
    folded = ((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 2048):
        part = folded[at : at + 2048]
        grid = _FACTORS[:, None] * part[None, :]
        grid += _ADDENDS[:, None]
        np.minimum(low, grid.min(axis=1), out=low)
    return low


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def bands_of(low: np.ndarray) -> np.ndarray:
    keys = (low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return signed(mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX))


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of every minimum, 64 // BITS to a long."""
    kept = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LONGS, 64 // BITS)
    return signed((kept << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64))


FIELDS = "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>, " + ", ".join(f"s{k} bigint" for k in range(LONGS))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, keys, bands, signs = [], [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            hashes = shingles(words)
            sizes.append(len(hashes))
            keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
            low = minima(hashes) if words else None
            bands.append(bands_of(low) if words else None)
            signs.append(packed(low).tolist() if words else [None] * LONGS)
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        columns += [pa.array([s[k] for s in signs], pa.int64()) for k in range(LONGS)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "bands", *[f"s{k}" for k in range(LONGS)]])


def signatures(documents: DataFrame) -> DataFrame:
    needed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(needed.mapInArrow(_sign, FIELDS), "signatures")


def differing(a: str, b: str) -> str:
    """SQL: how many of the retained minima differ."""
    odd = int("01" * 32, 2) if BITS == 2 else None
    pair = [f"({a}.s{k} ^ {b}.s{k})" for k in range(LONGS)]
    return " + ".join(f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {odd}L)" for x in pair)


def estimate(a: str, b: str) -> str:
    """SQL: the similarity that the signatures show, corrected for chance agreement."""
    chance = 2.0**-BITS
    return f"((1 - ({differing(a, b)}) / {HASHES}.0) - {chance}) / {1 - chance}"


def least_estimate(threshold: int) -> float:
    """DEVIATIONS standard deviations of the estimate under the threshold."""
    chance, t = 2.0**-BITS, threshold / 100
    agree = t + (1 - t) * chance
    return t - DEVIATIONS * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


def estimates(signs: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The same estimate of signatures (rows of uint64) with one signature."""
    odd, chance = np.uint64(0x5555555555555555), 2.0**-BITS
    differ = signs ^ one
    different = np.bitwise_count((differ | (differ >> np.uint64(1))) & odd).sum(axis=1)
    return ((1 - different / HASHES) - chance) / (1 - chance)


def sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, shingles of the wanted documents (doc_id, distinct). Texts aren't shuffled: a bitmap of the ids' hashes, of at
    most MOST_BITS bits, goes to all tasks, which make sets of what it lets through; a full bitmap lets all through."""
    wanted = materialize(wanted, "wanted")
    n = wanted.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = wanted.select((place / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id), {bits}), 64) as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.column(2).to_numpy(zero_copy_only=False)
            own = np.flatnonzero(shared.value[at >> 6] >> (at & 63) & 1)
            part = batch.take(pa.array(own))
            sets = [signed(shingles(words_of(text))) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    likely = texts.withColumn("place", place.cast("int")).mapInArrow(made, "doc_id bigint, shingles array<bigint>")
    kept = materialize(likely, "sets")
    shared.destroy()
    return kept.join(wanted, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, documents: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets reach the threshold."""
    pairs = materialize(pairs, "pairs")
    sets = sets_of(documents, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    parts = pairs.groupBy("a").agg(parts_of("b"))
    both = meet(pairs.join(right, "b"), left.join(parts, "a"), ["a"], "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return materialize(both.where(100 * shared >= threshold * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "confirmed")


def blocked(members: DataFrame) -> DataFrame:
    """members (hub, doc_id, component, ...) once per pair of blocks (i, j) of their hub's group that holds two components;
    side tells whether a row is of block i, j or both.

    A component of more than BLOCK members has blocks of its own, smaller ones share blocks. Blocks of one component are
    never paired, so a star with one stray costs its members once, not once for each of its blocks. What several branches
    of the plan need is written once, for the driver holds every exchange and broadcast of a plan at the same time.
    """
    sizes = materialize(members.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("_m"), parts_of("doc_id")), "sizes")
    sizes = sizes.withColumn("_k", F.when(F.col("_m") > BLOCK, F.ceil(F.col("_m") / BLOCK).cast("int")))
    few = F.sum(F.when(F.col("_k").isNull(), F.col("_m")))
    hubs = materialize(sizes.groupBy("hub").agg(F.ceil(few / BLOCK).cast("int").alias("_n"), parts_of("component")), "hubs")
    large, small = sizes.where("_k is not null").select("hub", "component", "_k"), hubs.where("_n is not null").select("hub", "_n")
    # A block is (component, number); the shared ones are of component null, written as 'x'.
    name = lambda component, number: F.concat_ws(":", component.cast("string"), number.cast("string"))
    counted = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    shared = F.lit("x")
    among = small.select("hub", F.explode(counted("_n")).alias("p"), "_n").select("hub", "p", F.explode(F.expr("sequence(p, _n - 1)")).alias("q"))
    pairs = among.select("hub", name(shared, F.col("p")).alias("i"), name(shared, F.col("q")).alias("j"))
    beside = large.join(small, "hub").select("hub", "component", F.explode(counted("_k")).alias("p"), "_n").select("hub", "component", "p", F.explode(counted("_n")).alias("q"))
    pairs = pairs.union(beside.select("hub", name(F.col("component"), F.col("p")), name(shared, F.col("q"))))
    other = large.select("hub", F.col("component").alias("_c"), F.col("_k").alias("_o"))
    apart = large.join(other, "hub").where(F.col("component") < F.col("_c")).select("hub", "component", "_c", F.explode(counted("_k")).alias("p"), "_o").select("hub", "component", "_c", "p", F.explode(counted("_o")).alias("q"))
    pairs = pairs.union(apart.select("hub", name(F.col("component"), F.col("p")), name(F.col("_c"), F.col("q"))))

    known = meet(sizes.drop("_m"), hubs, ["hub"], "component", "left")
    placed = meet(members, known, ["hub", "component"], "doc_id")
    number = lambda key, k: F.pmod(F.xxhash64(key), F.col(k))
    own = F.when(F.col("_k").isNotNull(), name(F.col("component"), number("doc_id", "_k"))).otherwise(name(shared, number("component", "_n")))
    placed = placed.withColumn("side", own).drop("_k", "_n")
    either = pairs.select("hub", F.explode(F.array_distinct(F.array("i", "j"))).alias("side"), "i", "j")
    return placed.join(either, ["hub", "side"])


def _sides(table: pa.Table, i: str, j: str) -> tuple[np.ndarray, np.ndarray]:
    side = np.array(table["side"].to_pylist(), object)
    return np.flatnonzero(side == i), np.flatnonzero(side == j)


def _suspects(threshold: int):
    least = least_estimate(threshold)

    def found(key: tuple, table: pa.Table) -> pa.Table:
        """hub, doc_id of members with a likely partner in another component."""
        left, right = _sides(table, key[1].as_py(), key[2].as_py())
        component, sizes, ids = table["component"].to_numpy(), table["n_shingles"].to_numpy(), table["doc_id"].to_numpy()
        signs = np.column_stack([table[f"s{k}"].to_numpy() for k in range(LONGS)]).view(np.uint64)
        hit = np.zeros(len(ids), bool)
        for x in left.tolist():
            far = right[(component[right] != component[x]) & (100 * np.minimum(sizes[right], sizes[x]) >= threshold * np.maximum(sizes[right], sizes[x]))]
            if len(far):
                near = far[estimates(signs[far], signs[x]) >= least]
                hit[near] = True
                hit[x] |= len(near) > 0
        own = ids[hit]
        return pa.table({"hub": pa.array(np.full(len(own), key[0].as_py(), np.int64)), "doc_id": pa.array(own)})

    return found


def _joining(threshold: int):
    def found(key: tuple, table: pa.Table) -> pa.Table:
        """Links (a, b) that join the components of a block pair: full sets, as products of membership matrices."""
        left, right = _sides(table, key[1].as_py(), key[2].as_py())
        component, ids = table["component"].to_numpy(), table["doc_id"].to_numpy()
        sets = table["shingles"].combine_chunks()
        values, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        sizes, owner = np.diff(ends), np.repeat(np.arange(len(ids)), np.diff(ends))
        _, column, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], number[column[keep]]
        common = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(shared.sum()), 8192):
            part = (column >= at) & (column < at + 8192)
            member = np.zeros((len(ids), 8192), np.float32)
            member[owner[part], column[part] - at] = 1
            common += member[left] @ member[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - common
        x, y = np.nonzero((100 * common >= threshold * union) & (component[left][:, None] != component[right][None, :]))
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.setdefault(c, c) != c:
                c = root[c] = root[root[c]]
            return c

        links = []
        for p, q in zip(left[x].tolist(), right[y].tolist(), strict=True):
            one, two = top(int(component[p])), top(int(component[q]))
            if one != two:
                root[max(one, two)] = min(one, two)
                links.append((int(ids[p]), int(ids[q])))
        return pa.table({"a": pa.array([p for p, _ in links], pa.int64()), "b": pa.array([q for _, q in links], pa.int64())})

    return found


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the links (a, b). Every round each node takes the
    smallest label around it and then that label's own label; sums of minima are partial before each shuffle."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"), parts_of("b")), "labels")
    while True:
        around = meet(both, labels.withColumnRenamed("node", "b"), ["b"], "a").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        closer = labels.join(around, "node").select("node", F.least("component", "near").alias("via"), F.col("component").alias("old"), F.col("_bits").alias("bits"))
        closer = materialize(closer, "closer")
        roots = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = materialize(meet(closer, roots, ["via"], "node", "left").select("node", F.least(F.col("via"), F.coalesce("far", "via")).alias("component"), "old", F.col("bits").alias("_bits")), "labels")
        labels = new.select("node", "component", "_bits")
        if not new.where("component != old").limit(1).count():
            return labels.select("node", "component")


def cluster(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of documents."""
    signed_docs = signatures(documents)
    classes = signed_docs.where("doc_id is not null and key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), parts_of("doc_id"))
    classes = materialize(classes, "classes")
    signature = [f"s{k}" for k in range(LONGS)]
    firsts = signed_docs.join(classes.select(F.col("key").alias("k"), "first"), (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("first")))
    firsts = materialize(firsts.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("n_shingles", "bands", *signature)]), "firsts")
    members = firsts.select("doc_id", "n_shingles", *signature, F.posexplode("bands").alias("band", "bucket"))
    sizes = members.groupBy("band", "bucket").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("m"), parts_of("doc_id")).where("m > 1")
    crowded = materialize(meet(members, sizes.drop("m"), ["band", "bucket"], "doc_id"), "buckets")

    # A hub's own row and the parts of its star come from one aggregate.
    own = [F.max(F.when(F.col("doc_id") == F.col("hub"), F.col(c))).alias(c) for c in ("n_shingles", *signature)]
    hubs = crowded.groupBy("hub").agg(*own, parts_of("doc_id"))
    stars = crowded.where("doc_id != hub").select("hub", "doc_id", "n_shingles", *signature).dropDuplicates(["hub", "doc_id"])
    stars = materialize(stars, "stars")
    alike = f"{estimate('x', 'y')} >= {least_estimate(threshold)} and 100 * least(x.n_shingles, y.n_shingles) >= {threshold} * greatest(x.n_shingles, y.n_shingles)"
    center = hubs.select("hub", F.struct("n_shingles", *signature).alias("y"), "_bits")
    pairs = meet(stars.select("hub", "doc_id", F.struct("n_shingles", *signature).alias("x")), center, ["hub"], "doc_id").where(alike).select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))

    links = confirmed(pairs, documents, threshold)
    labels = components(links)

    # Stars whose members lie in several components: members against each other.
    known = labels.withColumnRenamed("node", "doc_id")
    members = stars.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = members.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), parts_of("doc_id")).where("lo != hi").select("hub", "_bits")
    members = materialize(meet(members, mixed, ["hub"], "doc_id"), "mixed")
    suspects = blocked(members).groupBy("hub", "i", "j").applyInArrow(_suspects(threshold), "hub bigint, doc_id bigint")
    suspects = materialize(suspects.distinct(), "suspects")
    if not suspects.isEmpty():
        sets = sets_of(documents, suspects.select("doc_id").distinct())
        doubtful = members.join(suspects, ["hub", "doc_id"], "left_semi").select("hub", "doc_id", "component").join(sets, "doc_id")
        extra = materialize(blocked(doubtful).groupBy("hub", "i", "j").applyInArrow(_joining(threshold), "a bigint, b bigint"), "across")
        if not extra.isEmpty():
            labels = components(links.union(extra))

    named = classes.join(labels.withColumnRenamed("node", "first"), "first", "left").select("key", F.coalesce("component", "first").alias("found"), "_bits")
    out = meet(signed_docs.select("doc_id", "n_shingles", "key"), named, ["key"], "doc_id", "left")
    component = F.coalesce("found", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of documents, one of each group of near duplicates (the smallest doc_id), all columns as they were."""
    gone = cluster(documents, threshold).where(~F.col("kept")).select(F.col("doc_id").alias("_qg_gone"))
    return documents.join(gone, documents["doc_id"] == gone["_qg_gone"], "left_anti")
