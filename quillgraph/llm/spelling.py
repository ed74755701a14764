"""Spelling variants by a dictionary of pairs of trie nodes.

The words are put into two tries, one of the words and one of the words written backwards, and every node has a number, so a
prefix and a suffix of a word are two integers. Leaving out the letter at place i gives the pair (node of the prefix before
i, node of the suffix behind i); cutting the word between two letters, without leaving one out, gives such a pair too. Two
words that share a pair of the first kind differ by one replaced letter; a word's pair of the first kind that is another's of
the second kind tells of one inserted letter. So one grouping by integer pairs finds all neighbours, exactly and with no
candidate to be checked. A deletion inside a run of equal letters counts at the run's first place only: each neighbour is
found once. A pair is shared by at most one word for each letter of the alphabet (91 with the cut word), whatever the
table's size, so the lists of a group are bounded.

Tries are numbered over words in order: the words are dealt to parts by boundaries drawn from at most MOST_PARTS words, and
a part numbers a node when it first comes by it. Only prefixes of the boundaries can lie in several parts; those have numbers
of their own, by the boundary and the depth.

Defined results: a null text has no words, a null doc_id is written as an empty text in h; repeated rows count as often as
they are there; words of any length are whole; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, meet, parts_of, slices

EVERY, SHORTEST, LEAST, TIMES = 199, 6, 5, 5
#: Words of a part of a trie, most parts, letters of a boundary; words that a task counts before it hands them on.
PART, MOST_PARTS, LETTERS, HELD = 50_000, 4096, 64, 200_000


def words(documents: DataFrame, every: int = EVERY, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: runs of letters of at least `shortest` letters that occur `least` times or more, A-Z in lower case. A run
    whose h (crc32 of `<doc_id>:<run>`) is a multiple of `every` loses the letter at h % length."""
    runs = re.compile(rf"[a-zÀ-ÿ]{{{shortest},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        letters = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                name = f"{'' if doc_id is None else doc_id}:".encode()
                for run, n in Counter(runs.findall(text.encode().lower().decode())).items():  # bytes.lower(): A-Z only
                    h = crc32(name + run.encode())
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                    counts[run] += n
                    letters += len(run)
                if len(counts) > HELD or letters > 100 * HELD:
                    yield out()
                    counts.clear()
                    letters = 0
        yield out()

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def boundaries(vocabulary: DataFrame, column: str, rows: int) -> list[str]:
    """Where the words are divided: every 16th of a draw of 16 words a part, cut to LETTERS letters."""
    parts = min(MOST_PARTS, -(-rows // PART))
    if parts < 2:
        return []
    drawn = vocabulary.select(F.substring(column, 1, LETTERS).alias("w"), F.xxhash64("id").alias("h")).orderBy("h").limit(16 * parts)
    return sorted({w for w in sorted(r.w for r in drawn.collect())[16::16] if w})


def trie(vocabulary: DataFrame, bounds: list[str]) -> DataFrame:
    """id, nodes (the numbers of the nodes of a word's prefixes, from the empty one), heads (whether each letter differs from
    the one before), of vocabulary (id, w)."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(bounds, w) for w in batch.column(1).to_pylist()], pa.int32())], names=["id", "w", "part"])

    def boundary_node(w: str, depth: int) -> int:
        return -(bisect_left(bounds, w[:depth]) * (LETTERS + 1) + depth)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, nodes, last = -1, "", [0], 0
        for some in slices(batches, 4096):
            found, heads = [], []
            for w, own in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                if own != part:
                    part, before, nodes, last = own, "", [0], own << 40
                common = _shared(before, w)
                split = max((_shared(b, w) for b in bounds[max(own - 1, 0) : own + 1]), default=0)
                nodes = nodes[: common + 1]
                for depth in range(common + 1, len(w) + 1):
                    if depth <= split:
                        nodes.append(boundary_node(w, depth))
                    else:
                        last += 1
                        nodes.append(last)
                before = w
                found.append(nodes)
                heads.append([k == 0 or w[k] != w[k - 1] for k in range(len(w))])
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.bool_()))], names=["id", "nodes", "heads"])

    parts = vocabulary.select("id", "w").mapInArrow(dealt, "id bigint, w string, part int")
    return parts.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "w").mapInArrow(numbered, "id bigint, nodes array<bigint>, heads array<boolean>")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """id, n_near, best of every word of vocabulary (id, word) with a neighbour: how many there are, and the smallest id."""
    rows = vocabulary.count()
    forward = vocabulary.select("id", F.col("word").alias("w"))
    backward = vocabulary.select("id", F.reverse("word").alias("w"))
    p = trie(forward, boundaries(forward, "w", rows))
    s = trie(backward, boundaries(backward, "w", rows)).select("id", F.col("nodes").alias("ends"))
    both = p.join(s, "id").withColumn("at", F.explode(F.expr("sequence(0, 2 * size(heads))")))
    # Places 0 to length are cuts, the others leave a letter out.
    pair = both.select(
        "id",
        F.expr("if(at <= size(heads), nodes[at], nodes[at - size(heads) - 1])").alias("p"),
        F.expr("if(at <= size(heads), ends[size(heads) - at], ends[2 * size(heads) - at])").alias("s"),
        F.expr("if(at <= size(heads), null, heads[at - size(heads) - 1])").alias("head"),
    )
    without = F.when(F.col("head").isNotNull(), F.struct("id", "head"))
    groups = pair.groupBy("p", "s").agg(F.array_sort(F.collect_list(without)).alias("w"), F.max(F.when(F.col("head").isNull(), F.col("id"))).alias("cut"))
    groups = groups.where("size(w) > 1 or size(w) = 1 and cut is not null and w[0].head").withColumn("longer", F.expr("filter(w, x -> x.head)"))
    replaced = """transform(w, x -> struct(x.id as id, size(w) - 1 + if(x.head and cut is not null, 1, 0) as k,
        least(if(x.id = w[0].id, get(w, 1).id, w[0].id), if(x.head, cut, null)) as best))"""
    cut = "if(cut is not null and size(longer) > 0, array(struct(cut as id, size(longer) as k, longer[0].id as best)), array())"
    near = groups.select(F.explode(F.expr(f"concat({replaced}, {cut})")).alias("x")).where("x.k > 0")
    return near.groupBy("x.id").agg(F.sum("x.k").alias("n_near"), F.min("x.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root: where the chain of forms (id, to) ends. Each round doubles the steps; a form occurs five times as often as
    its word, so chains are as short as a logarithm of the largest count. Forms may be common, so they are met in parts."""
    reached = materialize(forms.select("id", "to"), "forms")
    while True:
        onward = reached.select(F.col("id").alias("to"), F.col("to").alias("then"))
        onward = onward.join(reached.groupBy("to").agg(parts_of("id")), "to")
        new = materialize(meet(reached, onward, ["to"], "id", "left").select("id", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")), "forms")
        reached = new.select("id", "to")
        if new.where("moved").isEmpty():
            return reached.select("id", F.col("to").alias("root"))


def variants(counted: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of counted words (word, n)."""
    # Ids follow (n descending, word), so the best of several words is the one with the smallest id.
    ordered = materialize(counted.select("word", "n"), "words").orderBy(F.desc("n"), "word")
    vocabulary = materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    near = materialize(neighbours(vocabulary), "near")
    best = vocabulary.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = vocabulary.join(near, "id", "left").join(best, "best", "left")
    fit = F.col("form_n") >= times * F.col("n")
    known = linked.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fit, F.col("best")).alias("to"), F.when(fit, F.col("form")).alias("form"), F.when(fit, F.col("form_n")).alias("form_n"))
    known = materialize(known, "known")
    ends = roots(known.where("to is not null"))
    last = vocabulary.select(F.col("id").alias("root"), F.col("word").alias("_last"))
    named = meet(ends, last, ["root"], "id").select("id", "_last")
    return known.join(named, "id", "left").select("word", "form", F.coalesce("_last", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
r AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
b AS (
  SELECT doc_id, run, k, list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), CAST(128 + (ord(c) & 63) AS BIGINT)] END))) AS bytes FROM r),
h AS (SELECT run, k, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM b, t),
v AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
s AS MATERIALIZED (
  SELECT word, n, left(word, i) AS p, substr(word, i + 2) AS s, length(word) AS m FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
c AS MATERIALIZED (SELECT word, n, left(word, i) AS p, substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM v)),
e AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM s a JOIN s b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT s.word, c.word, c.n FROM s JOIN c ON s.p = c.p AND s.s = c.s
  UNION SELECT c.word, s.word, s.n FROM s JOIN c ON s.p = c.p AND s.s = c.s),
f AS MATERIALIZED (
  SELECT v.word, v.n, count(other) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS top FROM v LEFT JOIN e USING (word) GROUP BY v.word, v.n),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN top >= 5 * n THEN best END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM f),
w(word, root) AS (SELECT word, word FROM g UNION ALL SELECT w.word, g.form FROM w JOIN g ON g.word = w.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, w.root, g.n, g.n_near, g.form_n FROM g JOIN w ON w.word = g.word JOIN g z ON z.word = w.root WHERE z.form IS NULL
"""
