"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network with a temperature.

1. Words. A unit of text is a run of letters, a digit or a run of other signs. The most frequent words over all documents, at most
   `size`, have rows of their own, one for capitals and one for other shapes: as many words as whole classes of frequency
   (eighths of a power of two) allow, so that no order among equals decides. Other words share RARE rows, digits and signs SIGNS.
   Random indexing: each row has a sparse ternary index vector, made from a hash of its name. Over all documents, a row's
   context vector is the sum of the index vectors of its units' neighbours. The sums are of integers, hence equal in every run
   and on any cluster. Tasks sum their own documents first; what is shuffled is a row per word and task.
2. Pooling. A document's features are the mean context vector of its words, the mean over its distinct words (the two
   differ where a text repeats itself), the log of its length, and the shares of words that are distinct and that equal
   the word before them.
3. A network of one hidden layer is fitted by numpy on the driver, on at most `max_rows` labelled rows (the parameter
   bounds what reaches the driver), then a temperature is fitted on a part held back from the gradient.
4. All documents are scored with the weights and vectors broadcast; both have a bounded size (size * dims).

Scores never see labels, lang, source or doc_id. Defined results: a null or empty text has zero features and gets the
network's score for them; no usable label of one of the classes gives the share of label 1 (0.5 without any) as score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, slices

SIZE, RARE, SIGNS = 1 << 15, 4096, 1024
DIMS, NONZERO, REACH = 32, 4, 2
WIDTH = 2 * DIMS + 3
#: Units whose contexts are summed at a time; units whose rows a task remembers.
PART, MEMORY = 1 << 15, 500_000
MAX_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4

_UNIT = re.compile(r"[^\W\d_]+|[0-9]|[^\w\x09-\x0D\x20]+|_+")


def frequent(documents: DataFrame, size: int = SIZE) -> list[str]:
    """At most `size` lower-case words: those of the highest classes of frequency that fit."""
    words = documents.select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"\P{L}+")).alias("word")).where("word != ''")
    counts = materialize(words.groupBy("word").agg(F.floor(8 * F.log2(F.count(F.lit(1)))).cast("int").alias("level")), "words")
    left, least = size, 0
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 512 levels
        left -= row["count"]
        if left < 0:
            least = row["level"] + 1
            break
    return counts.where(F.col("level") >= least).select("word").toArrow()["word"].to_pylist()  # at most size rows


class Words(dict):
    """Unit -> row, remembered for at most MEMORY units; known: the words with rows of their own, in order."""

    def __init__(self, known: list[str]) -> None:
        self.known = {w: k for k, w in enumerate(sorted(known))}
        self.size = 2 * len(self.known) + RARE + SIGNS

    def __missing__(self, unit: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        low = unit.lower()
        capitals = low != unit and len(unit) > 1 and unit.isupper()
        at = self.known.get(low)
        if at is not None:
            row = 2 * at + capitals
        else:
            start = 2 * len(self.known)
            crc = zlib.crc32(low.encode("utf-8", "surrogatepass"), capitals)
            row = start + crc % RARE if unit[0].isalpha() else start + RARE + crc % SIGNS
        self[unit] = row
        return row

    def rows(self, text: str | None) -> np.ndarray:
        units = _UNIT.findall(text or "")
        return np.array(list(map(self.__getitem__, units)), np.int32)

    def names(self) -> list[str]:
        return [shape + w for w in self.known for shape in "aA"] + [f"#{k}" for k in range(RARE + SIGNS)]

    def __reduce__(self):
        return Words, (list(self.known),)


def index_vectors(words: list[str]) -> np.ndarray:
    """The sparse ternary vectors of rows by name: NONZERO places of +1 or -1, by the bits of a hash."""
    h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    out = np.zeros((len(words), DIMS), np.int8)
    for k in range(NONZERO):
        place = (h >> np.uint64(8 * k)) % np.uint64(DIMS)
        sign = (h >> np.uint64(40 + k)) & np.uint64(1)
        np.add.at(out, (np.arange(len(words)), place.astype(np.int64)), sign.astype(np.int8) * 2 - 1)
    return out


def _add_contexts(total: np.ndarray, seen: np.ndarray, rows: np.ndarray, index: np.ndarray) -> None:
    """Adds to `total` the index vectors around each of `rows`; a gap of REACH rows of the zero vector parts two texts."""
    for at in range(0, len(rows), PART):  # bounded memory for any length
        part = rows[max(0, at - REACH) : at + PART + REACH]
        own = slice(at - max(0, at - REACH), at - max(0, at - REACH) + min(PART, len(rows) - at))
        near = index[part]
        context = np.zeros_like(near)  # 2 * REACH neighbours of at most NONZERO: small numbers
        for shift in range(1, REACH + 1):
            context[shift:] += near[:-shift]
            context[:-shift] += near[shift:]
        part, context = part[own], context[own]
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.array([], np.int64)
        if len(starts):
            total[ranked[starts]] += np.add.reduceat(context[order], starts, axis=0, dtype=np.int64)
            seen[ranked[starts]] += np.diff(np.r_[starts, len(ranked)])


def context_sums(documents: DataFrame, words: Words) -> DataFrame:
    """row, n, v0, v1, ...: the random-indexing sums over all documents."""
    shared = documents.sparkSession.sparkContext.broadcast((words, index_vectors(words.names())))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = shared.value
        index = np.vstack([index, np.zeros((1, DIMS), np.int8)])
        total, seen = np.zeros((known.size + 1, DIMS), np.int64), np.zeros(known.size + 1, np.int64)
        gap = np.full(REACH, known.size, np.int32)
        for batch in slices(batches):
            waiting, length = [], 0
            for text in [*batch.column(0).to_pylist(), None]:
                waiting += [known.rows(text), gap]
                length += len(waiting[-2])
                if length > PART or text is None:
                    _add_contexts(total, seen, np.concatenate(waiting), index)
                    waiting, length = [], 0
        used = np.flatnonzero(seen[:-1])
        columns = [pa.array(used, pa.int32()), pa.array(seen[used], pa.int64()), *[pa.array(total[used, d], pa.int64()) for d in range(DIMS)]]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n", *[f"v{d}" for d in range(DIMS)]])

    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(partial, "row int, n bigint, " + ", ".join(f"v{d} bigint" for d in range(DIMS)))
    return parts.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMS)])


@dataclass
class Vectors:
    words: Words
    table: np.ndarray


def word_vectors(documents: DataFrame, size: int = SIZE) -> Vectors:
    """The context vectors of all rows on the driver: at most 2 * size + RARE + SIGNS."""
    words = Words(frequent(documents, size))
    table = context_sums(documents, words).toArrow()
    out = np.zeros((words.size, DIMS))
    if table.num_rows:
        out[table["row"].to_numpy()] = np.column_stack([table[f"v{d}"].to_numpy() for d in range(DIMS)])
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return Vectors(words, np.divide(out, norms, out=np.zeros_like(out), where=norms > 0).astype(np.float32))


def pooled(text: str | None, vectors: Vectors) -> np.ndarray:
    rows = vectors.words.rows(text)
    if not len(rows):
        return np.zeros(WIDTH, np.float32)
    distinct, counts = np.unique(rows, return_counts=True)
    known = vectors.table[distinct]
    again = float((rows[1:] == rows[:-1]).mean()) if len(rows) > 1 else 0.0
    return np.concatenate([counts.astype(np.float32) @ known / len(rows), known.mean(axis=0), [np.log1p(len(rows)) / 10, len(distinct) / len(rows), again]]).astype(np.float32)


@dataclass
class Model:
    """A two-layer network over standardized features, and its temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Adam on cross-entropy over four fifths of the rows, then the temperature that suits the last fifth best."""
    width = x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 10 or share in (0.0, 1.0):
        rate = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))), 1.0)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    part = max(1, len(y) // 5)
    held, used = order[:part], order[part:]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for at in np.array_split(draw.permutation(used), max(1, len(used) // 128)):
            h = np.tanh(z[at] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[at]) / len(at)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [z[at].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ error + DECAY * p[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits, heat = model.logits(x[held]), np.geomspace(0.5, 8, 60)
    losses = [np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t) for t in heat]
    model.temperature = float(heat[int(np.argmin(losses))])
    return model


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, label of at most max_rows documents outside the held-out fold, chosen by a hash of the id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[Vectors, Model]:
    """Word vectors of all documents, and a network fitted on at most max_rows labelled rows."""
    vectors = word_vectors(documents)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [pooled(text, shared.value).tolist() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    sample = materialize(labelled_sample(labels, max_rows), "labels")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")  # at most max_rows ids
    got = joined.mapInArrow(features, "doc_id bigint, label int, x array<float>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).toArrow()
    shared.destroy()
    x = got["x"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, WIDTH)  # no Python object a number
    return vectors, fit(x, got["label"].to_numpy().astype(np.float64))


def score(documents: DataFrame, vectors: Vectors, model: Model) -> DataFrame:
    """doc_id, score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast((vectors, model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, model = shared.value
        for batch in slices(batches):
            x = np.array([pooled(text, vectors) for text in batch.column(1).to_pylist()], np.float64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], names=["doc_id", "score"])

    needed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return needed.mapInArrow(scored, "doc_id bigint, score double")


def keep_good(documents: DataFrame, vectors: Vectors, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of documents whose score reaches the threshold, all columns as they were; one scan, no join."""
    shared, at = documents.sparkSession.sparkContext.broadcast((vectors, model)), documents.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, model = shared.value
        for batch in slices(batches):
            x = np.array([pooled(text, vectors) for text in batch.column(at).to_pylist()], np.float64).reshape(-1, WIDTH)
            yield batch.filter(pa.array(model.scores(x) >= threshold, pa.bool_()))

    return documents.mapInArrow(kept, documents.schema)
