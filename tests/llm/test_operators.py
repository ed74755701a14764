"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables
and columns whose names clash with the operators' own."""

from __future__ import annotations

import hashlib
import io
import json
import random
import re
import struct
import time
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import common, html_extract, line_dedup, media, mixing, near_dedup, packing, pii, quality_model, quality_rules, url_filter
from quillgraph.llm.queries import ORACLES, QUERIES
from tests.compare import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, kept boolean, _slice int"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}" if i and i % 5 else None, None if t is None else len(t), "x", True, 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def words():
    draw = random.Random(3)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 8))) for _ in range(400)]


@pytest.fixture(scope="module")
def texts(words):
    """Ids (one null, one twice) with texts: null, empty, blank, short, long, exact and near copies, shared passages."""
    draw = random.Random(5)
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage = "\n".join(line(20) for _ in range(4))
    base = [line(30) for _ in range(6)]
    out = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "One two  three four"), (6, "a b c a b c a b c"), (7, " ".join(["same"] * 80))]
    out += [(10 + k, "\n".join([line(25), passage, line(25)])) for k in range(4)]
    out += [(20 + k, "\n".join(base)) for k in range(3)]
    for k in range(6):
        near = [x.split() for x in base]
        for _ in range(k):
            row = draw.choice(near)
            row[draw.randrange(len(row))] = draw.choice(words)
        out.append((30 + k, "\n".join(" ".join(x) for x in near)))
    out += [(50, "\n".join(line(40) for _ in range(300))), (51, "x" * 50_000), (60, line(60)), (60, line(60)), (70, "### " * 60), (None, line(55)), (80, "nul\x00 é ü \u2003 \U0001f600 ß ﬁ Σίσυφος " + line(10))]
    out += [(61, out[-4][1])]
    return out


# 1 PII
def spans_brute(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_pii_equals_patterns():
    draw, anchors = random.Random(1), pii.automaton()
    pool = ["a", "b.", "@", "@x.y", ".", "-", "+", "+1", " ", "(", ")", "0", "25", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111-", "79927398713", "é", "\n", "://", "token = ", "IBAN ", "%", "_"]
    for _ in range(4000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 25)))
        assert [s for s in pii.spans_of(text, anchors) if s[1] < 4] == spans_brute(text), text


def test_pii_other_kinds():
    kinds = lambda text: [(pii.KINDS[k], text[s:e]) for s, k, e in pii.spans_of(text, pii.automaton())]
    assert kinds('token = "0123456789abcdef0123"') == [("secret", "0123456789abcdef0123")]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds("IBAN: GB82 WEST 1234 5698 7654 32.")
    assert kinds("IBAN: GB83 WEST 1234 5698 7654 32.") == []
    assert ("login", "bob:pw@host.example") in kinds("ftp://bob:pw@host.example/x")
    assert kinds("see http://host.example/x") == []


def test_pii_sql_on_all_kinds(spark, tmp_path):
    """The query and its SQL over texts with every kind, valid and not."""
    draw = random.Random(2)
    pool = ["a@b.cc ", "x@y", " 1.2.3.4 ", "1.2.3.256", "4111 1111 1111 1111 ", "4111-1111-1111-1112", "+1 (202) 555-0147 ", "+12", "IBAN: GB82 WEST 1234 5698 7654 32. ", "IBAN GB83 WEST 1234 5698 7654 32, ", "ftp://bob:pw@host.example/x ", "see http://host/ ",
            'token = "0123456789abcdef0123" ', "API_KEY: 'abcdefghijklmnop' ", "password=short ", "Secret=abcdefghijklmnopqrs;", "é\U0001f600 ", "\n"]
    rows = [(k, "".join(draw.choice(pool) for _ in range(draw.randint(0, 12))) if k else None) for k in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(QUERIES["op1_pii"](spark, str(tmp_path)))
    assert got == rows_of_sql(str(tmp_path), ORACLES["op1_pii"])
    found = QUERIES["op1_pii"](spark, str(tmp_path)).agg(*[F.sum(f"n_{k}").alias(k) for k in pii.KINDS]).first()
    assert all(found[k] > 5 for k in pii.KINDS)


def test_pii_rows(spark, texts):
    docs = frame(spark, [*texts, (90, "mail a@b.cc and 1.2.3.4")])
    rows = {(r.doc_id, r.spans): r for r in pii.find_pii(docs).collect()}
    assert len(rows) >= len(texts) - 2
    hit = rows[(90, "email:5:11,ip:16:23")]
    assert (hit.n_email, hit.n_ip, hit.base_sha256) == (1, 1, hashlib.sha256(b"email:5:11,ip:16:23").hexdigest())
    assert pii.find_pii(docs.where("false")).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}
    assert masked[90] == "mail <email> and <ip>" and masked[1] is None


# 2 quality rules
def repeated_brute(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)})


def test_quality_rules(spark, texts):
    rows = quality_rules.apply_policy(quality_rules.ledger(frame(spark, texts))).collect()
    assert len(rows) == len(texts)
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = []
    for _, t in texts:
        t = t or ""
        found = SPACE.findall(t)
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        n, rep = len(found), repeated_brute(found)
        want.append((n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n))
    assert got == sorted(want)
    assert all(not r.kept for r in rows if r.base_failed)


def test_ablations(spark, texts):
    entries = quality_rules.ledger(frame(spark, texts))
    bits = [r.failed_bits for r in entries.collect()]
    got = {r.rule: r for r in quality_rules.ablations(entries).collect()}
    for bit, name, _ in quality_rules.RULES:
        assert got[name].failing == sum(b >> bit & 1 for b in bits)
        assert got[name].failing_alone == sum(b == 1 << bit for b in bits)
        assert got[name].kept_by_all == sum(b == 0 for b in bits)
    assert quality_rules.ledger(frame(spark, texts).where("false")).count() == 0


# 3 quality classifier
def test_classifier_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert right > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def rows_brute(docs, size):
    """The words with rows of their own by counting, and each document's rows by name."""
    counts = Counter(w for t in docs for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
    levels = Counter(int(np.floor(8 * np.log2(n))) for n in counts.values())
    fits = [at for at in levels if sum(c for lv, c in levels.items() if lv >= at) <= size]
    known = {w for w, n in counts.items() if int(np.floor(8 * np.log2(n))) in fits}

    def name(unit):
        capitals = len(unit) > 1 and unit.isupper() and unit != unit.lower()
        if unit.lower() in known:
            return "aA"[capitals] + unit.lower()
        crc = zlib.crc32(unit.lower().encode(), int(capitals))
        return f"#{crc % quality_model.RARE}" if unit[0].isalpha() else f"#{quality_model.RARE + crc % quality_model.SIGNS}"

    return known, [[name(u) for u in quality_model._UNIT.findall(t or "")] for t in docs]


def contexts_brute(lines):
    """Row -> number, and sum of the index vectors of the units at most REACH places away."""
    want, times = defaultdict(lambda: np.zeros(quality_model.DIMS, int)), Counter()
    for line in lines:
        times.update(line)
        for i, row in enumerate(line):
            for j in range(max(0, i - quality_model.REACH), min(len(line), i + quality_model.REACH + 1)):
                if j != i:
                    want[row] += quality_model.index_vectors([line[j]])[0]
    return {w: (n, want[w].tolist()) for w, n in times.items()}


@pytest.mark.parametrize("size", [1000, 60, 0])
def test_context_sums_equal_brute_force(spark, texts, size):
    docs = ["a b c a", "", None, "b b", "c", "Ab AB ab 12 ...", *(t for _, t in texts[3:20])]
    frame_ = spark.createDataFrame([(t,) for t in docs], "text string").repartition(3)
    known, lines = rows_brute(docs, size)
    words = quality_model.Words(quality_model.frequent(frame_, size))
    assert set(words.known) == known and len(known) <= size
    names = words.names()
    assert len(names) == words.size
    got = {names[r.row]: (r.n, [r[f"v{d}"] for d in range(quality_model.DIMS)]) for r in quality_model.context_sums(frame_, words).collect()}
    assert got == contexts_brute(lines)


def features_brute(line, vectors):
    """line: the rows of a document by name."""
    if not line:
        return [0.0] * quality_model.WIDTH
    at = {name: k for k, name in enumerate(vectors.words.names())}
    of = lambda names: np.mean([vectors.table[at[x]].astype(float) for x in names], axis=0)
    return [*of(line), *of(sorted(set(line))), np.log1p(len(line)) / 10, len(set(line)) / len(line), sum(a == b for a, b in zip(line, line[1:])) / max(1, len(line) - 1)]


def scores_brute(lines, vectors, model):
    x = np.array([features_brute(line, vectors) for line in lines])
    z = np.tanh((x - model.mean) / model.scale @ model.w1 + model.b1) @ model.w2 + model.b2
    return 1 / (1 + np.exp(-np.clip(z / model.temperature, -40, 40)))


def test_scores_equal_brute_force(spark, texts):
    """Pooling and network, document by document without Spark."""
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(len(t or "") > 100)) for i, t in texts if i is not None and i != 60], "doc_id bigint, quality int")
    vectors, model = quality_model.train(docs, labels)
    assert quality_model.train(docs, labels)[1].b2 == model.b2
    _, lines = rows_brute([t for _, t in texts], quality_model.SIZE)
    counted, names = contexts_brute(lines), vectors.words.names()
    for k, name in enumerate(names):
        v = np.array(counted.get(name, (0, [0] * quality_model.DIMS))[1], float)
        assert np.allclose(vectors.table[k], v / (np.linalg.norm(v) or 1), atol=1e-6)
    got = sorted(r.score for r in quality_model.score(docs, vectors, model).collect())
    assert np.allclose(got, sorted(scores_brute(lines, vectors, model)), atol=1e-4)


def test_classifier_odd_tables(spark, texts):
    """Empty tables, clashing columns, repeated rows: at most max_rows labelled rows are fitted on."""
    docs = frame(spark, texts)
    clashing = docs.select("*", *[F.lit(1).alias(c) for c in ("word", "n", "v0", "score", "label", "x", "level", "row")])
    labels = spark.createDataFrame([(i, i % 2, "x") for i, _ in texts if i is not None], "doc_id bigint, quality int, text string")
    vectors, model = quality_model.train(clashing, labels, 7)
    assert quality_model.score(clashing, vectors, model).count() == len(texts)
    assert quality_model.keep_good(clashing, vectors, model).columns == clashing.columns
    vectors, model = quality_model.train(docs.where("false"), labels)
    assert quality_model.score(docs.where("false"), vectors, model).count() == 0 and vectors.words.known == {}


def test_classifier_without_labels(spark, texts):
    docs = frame(spark, texts)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    vectors, model = quality_model.train(docs, labels)
    scores = [r.score for r in quality_model.score(docs, vectors, model).collect()]
    assert len(scores) == len(texts) and all(abs(s - 0.5) < 1e-6 for s in scores)
    kept = quality_model.keep_good(docs, vectors, model, 0.3)
    assert kept.schema == docs.schema and kept.count() == len(texts)


# 4 line dedup
def dedup_brute(rows):
    """Rows (id, text) in order of id; windows as documented."""
    kinds, windows = {}, []
    for at, (i, t) in enumerate(rows):
        lines = [x.strip("\x09\x0a\x0b\x0c\x0d\x20") for x in (t or "").split("\n")]
        lines = [x for x in lines if x]
        for k in range(len(lines)):
            for width in (3, 2, 1):
                part = lines[k : k + width]
                size = sum(len(SPACE.findall(x)) for x in part)
                if len(part) == width and (width == 3 or size > 50 or len(lines) == width and size >= 10):
                    windows.append((tuple(part), at, k, width))
    gone = defaultdict(set)
    for part, at, k, width in windows:
        if part in kinds:
            first = kinds[part]
            gone[at] |= set(range(max(k, first[1] + width) if first[0] == at else k, k + width))
        else:
            kinds[part] = (at, k)
    return {rows[at][0]: sorted(x) for at, x in gone.items()}


def test_line_dedup(spark, texts):
    rows = sorted({(i, t) for i, t in texts if i is not None and i != 60}, key=lambda x: x[0])
    want = dedup_brute(rows)
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == len(rows)
    assert {i: r._n_removed for i, r in got.items() if r._n_removed} == {i: len(x) for i, x in want.items()}
    for i, t in rows:
        lines, n = [], 0
        for part in (t or "").split("\n"):
            if SPACE.search(part):
                lines += [part] if n not in want.get(i, ()) else []
                n += 1
            else:
                lines.append(part)
        kept = t if i not in want else ("\n".join(lines) if n > len(want[i]) else "")
        assert got[i].text == kept
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0
    assert line_dedup.dedup_lines(docs).columns[: len(docs.columns)] == docs.columns


def test_a_repeated_line_keeps_its_first_window(spark):
    rows = [(1, "a\na\na\na\nend"), (2, "x\ny\nx\ny\nx\ny\nx\ny"), (3, "b\na\na\na"), (4, "a\na\na")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "a\na\na\nend", 2: "x\ny\nx", 3: "b", 4: ""}


# 5 packing
@pytest.mark.parametrize("length, quantum", [(64, 16), (4096, 128)])
def test_packing(spark, texts, length, quantum):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    docs = frame(spark, texts).repartition(3)
    rows = packing.pack(docs, length=length, quantum=quantum, with_ids=True).collect()
    ids = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in texts)
    groups, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length > 0 and zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        groups[(r.doc_id, r.doc_tokens)].append(r)
    total = sum(len(x) * n for (_, x), n in ids.items())
    assert sum(r.length for r in rows) == total
    for key, n in Counter((i, len(x)) for (i, x), n in ids.items() for _ in range(n)).items():
        assert sum(r.length for r in groups[key]) == key[1] * n
    for (i, x), n in ids.items():
        if n == 1 and sum(1 for (j, y) in ids if j == i) == 1:
            whole = sorted((r.start, r.ids) for r in groups[(i, len(x))])
            assert tuple(t for _, part in whole for t in part) == x
    for k, parts in sequences.items():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end == length or (k >= total // length and end & (end - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(docs.where("false")).count() == 0


@pytest.mark.parametrize("shares", [None, [0.25, 0.5, None, None, 0.0], [0.0, 0.0, 0.7, 0.3, 0.0]])
def test_schedule_is_deficit_round_robin(shares):
    """Every quantum has a place of its own; windows hold the queues' shares, what is owed is carried on, and a queue has one
    run in a window."""
    lengths, quantum, length = np.array([100_000, 13_000, 70, 49_900, 3_333]), 16, 128
    schedule = packing.Schedule(lengths, quantum, length, shares)
    units, window = lengths // quantum, length // quantum
    own = np.repeat(np.arange(5), units)
    slots = np.concatenate([np.arange(n) for n in units])
    places = schedule.place(own, slots)
    assert sorted(places.tolist()) == list(range(0, int(units.sum()) * quantum, quantum))
    order = own[np.argsort(places)]
    # by brute force: the accounts of the queues still open, window by window
    given = np.array([0.0 if x is None else x for x in shares or [None] * 5])
    free = np.array([x is None for x in shares or [None] * 5])
    weights = given + free * (1 - given.sum()) * units / max(1, units[free].sum())
    owed, sent, open_ = np.zeros(5), np.zeros(5, int), units > 0
    for at in range(0, len(order), window):
        part = order[at : at + window]
        runs = [q for k, q in enumerate(part) if k == 0 or part[k - 1] != q]
        assert len(runs) == len(set(runs))
        rate = np.where(open_, weights, 0)
        rate = rate if rate.any() else np.where(open_, units, 0)
        sent += np.bincount(part, minlength=5)
        owed += len(part) * rate / rate.sum()
        closing = open_ & (sent == units)
        # at least the queues whose number stays the same keep their account within the tree's depth and one quantum of rounding
        if not closing.any() and rate[open_].all():
            assert np.abs(owed - sent)[open_].max() <= 3 + 1 + 5 * (shares is not None)
        owed = np.where(closing, sent, owed)
        if closing.any():
            owed = sent.astype(float)
        open_ &= ~closing
    assert (sent == units).all()
    assert [int(x) for x in schedule.place(np.arange(5), units)] == [int(units.sum()) * quantum + int((lengths % quantum)[:k].sum()) for k in range(5)]


def test_packing_to_targets(spark, words):
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choice(words) for _ in range(40)), "abc"[k % 3]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    pieces = packing.pack(docs, length=512, quantum=32, targets={"a": 0.5, "b": 0.25, "nobody": 0.1}).join(docs, "doc_id").collect()
    held = Counter()
    for r in pieces:
        held[r.source, r.sequence_id // 35] += r.length
    total = sum(r.length for r in pieces) // 3
    for s, want in {"a": 0.5, "b": 0.25, "c": 0.25}.items():
        assert abs(held[s, 0] / (512 * 35) - want) < 0.03
    # a has run out, b and c go on in equal parts
    late = [r for r in pieces if total / 0.5 / 512 + 2 < r.sequence_id < 3 * total // 512 - 1]
    assert {r.source for r in late} == {"b", "c"}
    assert abs(sum(r.length for r in late if r.source == "b") / sum(r.length for r in late) - 0.5) < 0.05
    # many small sources share a queue: nothing is lost
    few = packing.pack(docs.withColumn("source", F.col("doc_id").cast("string")), length=512, quantum=32, small=100).collect()
    assert sum(r.length for r in few) == sum(r.length for r in pieces)
    assert sorted((r.doc_id, r.doc_tokens) for r in few if r.start == 0) == sorted((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)


def test_encoder_agrees_with_tokenizer(words):
    encoder, draw = packing.Encoder.of(packing.default_tokenizer()), random.Random(2)
    pool = [*words[:50], "don't", "IT'S", "a1b22", "..!?", "ÀÉÎßøÿ", "×÷", "\x00\x1c\x85", "'S 'RE", " \t\r\n", "<|endoftext|>", "Σς", "e\u0301", "\xa0", "naïve", "ªµº", "x'tx"]
    for _ in range(300):
        text = draw.choice(["", " "]).join(draw.choice(pool) for _ in range(draw.randint(0, 30)))
        assert encoder.encode(text) == encoder.whole(text), text


# 6 near dedup
def components_brute(rows, threshold=85):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = SPACE.findall((t or "").translate(lower))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (len(a), top(i)) for i, a in sets}


def test_near_dedup(spark, texts, words):
    rows = [(i, t) for i, t in texts if i is not None and i != 60]
    draw = random.Random(8)
    base = [draw.choice(words) for _ in range(200)]
    for k in range(60):  # a large group that hangs together by some pairs only
        own = list(base)
        for _ in range(draw.randint(1, 6)):
            own[draw.randrange(200)] = draw.choice(words)
        rows.append((1000 + k, " ".join(own)))
    want = components_brute(rows)
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in near_dedup.cluster(docs).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_a_large_star_with_one_stray_costs_its_members_once(spark):
    """Blocks are paired across components only."""
    n = 50_000
    members = spark.range(n).select(F.lit(-1).cast("long").alias("hub"), F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.lit(7)).otherwise(F.lit(0)).cast("long").alias("component"))
    rows = near_dedup.blocked(members)
    assert rows.count() <= n + n // near_dedup.BLOCK + 2
    assert rows.groupBy("hub", "i", "j").count().agg(F.max("count")).first()[0] <= 2 * near_dedup.BLOCK
    # every pair of different components meets in a block pair
    small = spark.createDataFrame([(1, k, k % 3 if k % 7 else k) for k in range(60)], "hub bigint, doc_id bigint, component bigint")
    block, near_dedup.BLOCK = near_dedup.BLOCK, 8
    try:
        met = defaultdict(list)
        for r in near_dedup.blocked(small).collect():
            met[r.i, r.j].append((r.side, r.doc_id, r.component))
    finally:
        near_dedup.BLOCK = block
    pairs = Counter(tuple(sorted((x[1], y[1]))) for (i, j), own in met.items() for x in own if x[0] == i for y in own if y[0] == j and x[2] != y[2] and (i != j or x[1] < y[1]))
    want = {tuple(sorted((a, b))) for a in range(60) for b in range(a) if (a % 3 if a % 7 else a) != (b % 3 if b % 7 else b)}
    assert set(pairs) == want and set(pairs.values()) == {1}


def test_meet(spark):
    rows = spark.createDataFrame([(k % 3 if k % 10 else None, k) for k in range(200)], "key int, id int")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "key int, name string")
    assert sorted(common.meet(rows, one, ["key"], "id").select("key", "id", "name").collect()) == sorted(rows.join(one, "key").select("key", "id", "name").collect())
    order = lambda df: sorted(tuple(map(str, r)) for r in df.select("key", "id", "name").collect())
    assert order(common.meet(rows, one, ["key"], "id", "left")) == order(rows.join(one, "key", "left"))


def test_near_dedup_odd_rows(spark, texts):
    rows = near_dedup.cluster(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert near_dedup.cluster(frame(spark, texts).where("false")).count() == 0


def test_estimate_follows_similarity():
    draw = np.random.default_rng(0)
    for similar in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(20):
            common = draw.integers(0, 1 << 63, 1000, np.uint64)
            only = int(1000 * (1 - similar) / (2 * similar))
            a, b = (np.concatenate([common, draw.integers(0, 1 << 63, only, np.uint64)]) for _ in range(2))
            x, y = near_dedup.packed(near_dedup.minima(a)).view(np.uint64), near_dedup.packed(near_dedup.minima(b)).view(np.uint64)
            differ = x ^ y
            different = int(np.bitwise_count((differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
            errors.append(((1 - different / near_dedup.HASHES) - 0.25) / 0.75 - similar)
        assert abs(np.mean(errors)) < 0.05


# 7 URL filters
def verdict_brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if blocked_brute(host, path) else "allow"


def blocked_brute(host, path):
    """By labels and segments, without expressions."""
    u = url_filter
    for label in re.split(r":", host)[0].split("."):
        own = label.split("-")
        if any(w in (*u.GAMBLING, *u.ADULT, *u.DRUGS, *u.SPAM, *u.ADVERTS) for w in own):
            return True
        for one, two in ((u.BAITS, u.GOODS), (u.CLICKS, u.TRACKERS)):
            if any(w in one for w in own) and any(w in two for w in own):
                return True
    for segment in path.split("/")[1:]:
        name, dot, kind = segment.partition(".")
        if tuple(name.split("-")) in u.PATHS and (not dot or kind and all("a" <= c <= "z" for c in kind)):
            return True
    return False


URLS = [None, "", "nothing", "http://", "://", "HTTP://EXAMPLE.ORG/es/1", "http://a.example.org/en/12?x", "http://aexample.org/en/1", "http://org/", "http://org", "http://x.ORG#a", "http://x.com/fr/", "http://x.com/fr", "http://Q.com/de/?/fr/",
        "http://x.cheap-pills.net/a", "http://xcheap-pills.net/", "http://spam-farm.net", "http://a.org/x://b.com/de/", "http://é.com/de/ü", "http://u:p@x.com:80/fr/1\n2", "http://free-bets.io/x", "http://adult-x.io/1", "http://adulty.io/1",
        "http://casino.io", "http://my-casino.io:80/x", "http://x.casino", "http://casinos-of-old.io/", "http://pills-for-cheap.io", "http://cheap.pills.io", "http://x.io/wp-login.php", "http://x.io/a/cgi-bin/b", "http://x.io/wp-logins", "http://ads-x-track.io", "http://track.io/ads"]


@pytest.mark.parametrize("most", [20_000, 0])
def test_url_filter(spark, most):
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS + URLS[:2])], "page_id int, url string, host string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, most=most).orderBy("page_id").collect()]
    assert got == [verdict_brute(u) for u in URLS + URLS[:2]]
    assert url_filter.judge(pages.where("false"), most=most).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, [], most=most).collect()} == {"allow"}


def test_url_rules_from_a_table(spark):
    """Thousands of rules as a table, both ways alike; a rule without a token is fetched by all."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcde") for _ in range(3))
    rules = [url_filter.site_rule(word(), word()) for _ in range(3000)] + [url_filter.Rule(r"^[0-9]+(?:[.][0-9]+){3}(?:/|$)", (), "block"), url_filter.prefix_rule("allow", "net", "/x"), url_filter.prefix_rule("block", "net", "/x")]
    urls = [f"http://{word()}-{word()}.{draw.choice(['net', 'io'])}/{draw.choice('xy')}/{word()}" for _ in range(300)] + ["http://10.0.0.1/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    table = url_filter.rule_table(spark, rules)
    compiled = [(r, re.compile(r.pattern)) for r in rules]
    one, two = ([tuple(r) for r in url_filter.judge(pages, table, most=most).orderBy("page_id").collect()] for most in (20_000, 100))
    assert one == two
    for url, row in zip(urls, one, strict=True):
        fits = [r for r, pattern in compiled if pattern.search("".join(row[1:3]))]
        longest = max((r for r in fits if r.prefix), key=lambda r: (len(r.prefix), r.verdict), default=None)
        assert row[3:5] == ((longest.prefix, longest.verdict) if longest else (None, "block" if fits else "allow")), url
        assert row[6] == len({(r.pattern, r.verdict) for r in fits}) and row[5] < 300
    assert sum(r[4] == "block" for r in one) > 20


# 8 media
def test_media(spark, texts):
    rows = media.media_features(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for (_, t), r in zip(texts, rows, strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setparams((1, 1, 8000, 0, "NONE", ""))
            f.writeframes(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        assert by_text.setdefault(payload, r.feature) == r.feature and len(r.times) == len(r.codes)
    stored = media.media_files(frame(spark, texts)).collect()
    assert [media.from_wav(bytes(r.media)) for r in stored] == [media.payload_of(t) for _, t in texts]
    assert media.media_features(frame(spark, texts).where("false")).count() == 0


def test_fingerprint_by_definition():
    draw = np.random.default_rng(4)
    samples = draw.integers(0, 256, 192 * 30, np.uint8)
    bins, power = media.strongest(samples)
    peaks = [t for t in range(len(bins)) if all(power[t] > power[u] if u < t else power[t] >= power[u] for u in range(max(0, t - media.NEAR), min(len(bins), t + media.NEAR + 1)) if u != t)]
    want = sorted((t, int(bins[t]) << 14 | int(bins[u]) << 7 | (u - t)) for k, t in enumerate(peaks) for u in peaks[k + 1 : k + 1 + media.FAN] if u - t <= media.SPAN)
    times, codes, n = media.fingerprint(samples)
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == want and n == 59


# 9 HTML
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a>Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div><aside><p>side</p></aside>
%s<section class="comments"><p>reader says</p></section><form><input value="x">Sign up</form><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize(
    "article, want",
    [
        ("<article><h1>A &amp; B</h1><p>one <b>two</b>\n three<p>four<br>five</article>", "A & B\n\none two three\n\nfour five"),
        ("<article><p>x<ul><li>i<li>j</ul><div class='ad'>buy</div>tail</article>", "x\n\ni\n\nj\n\ntail"),
        ("<main><div><h2>H</h2>text &lt;p&gt; &#233;</div></main>", "H\n\ntext <p> é"),
        ("<article><p>cut &am", "cut &am"),
        ("<article></article>", ""),
    ],
)
def test_html_pages(spark, article, want):
    html = PAGE % article if "cut" not in article else (PAGE % article).split("<section")[0]
    rows = spark.createDataFrame([(1, "http://h/1", html), (2, None, None), (3, "http://h/2", ""), (1, "http://h/1", html)], "page_id int, url string, html string")
    got = html_extract.extract(rows.withColumn("text", F.lit("t"))).orderBy("page_id").collect()
    assert [r.text for r in got] == [want, want, "", ""] and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(rows.where("false")).count() == 0


def test_wrapper_finds_the_article_without_tags(spark):
    page = "<html><body><div class='top'><p>Welcome to the site</p></div><div class='content'><h2>Title {0}</h2><p>Story {0} {1}</p><p>More {1}</p></div><div class='bottom'>Imprint</div></body></html>"
    rows = [(k, "http://plain.example/x", page.format(k, " ".join(f"w{k}{j}" for j in range(20 + k)))) for k in range(8)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)).collect()
    assert len(got) == 8
    for r in got:
        assert r.text.startswith(f"Title {r.page_id}\n\nStory {r.page_id} ") and "Imprint" not in r.text and "Welcome" not in r.text


def texts_of(spark, pages):
    rows = spark.createDataFrame([(k, "http://plain.example/x", page) for k, page in enumerate(pages)], "page_id int, url string, html string").repartition(2)
    return [r.text for r in html_extract.extract(rows).orderBy("page_id").collect()]


@pytest.mark.parametrize(
    "body, want",
    [
        # the title, and a lead, outside the body's container
        ("<div class='wrap'><h1>Title {k}</h1><p>lead {k}</p><div class='entry'><p>{long}</p></div></div>", "Title {k}\n\nlead {k}\n\n{long}"),
        # a long list in an article
        ("<div class='content'><h1>Title {k}</h1><p>p {k}</p><ul><li>{long}</li><li>x {k}</li></ul></div>", "Title {k}\n\np {k}\n\n{long}\n\nx {k}"),
        ("<div class='content'><ul><li>{long}</li><li>x {k}</li></ul></div>", "{long}\n\nx {k}"),
        # two parts side by side; the text of the container itself
        ("<div class='one'><p>{long}</p></div><div class='two'><p>rest {k}</p></div>", "{long}\n\nrest {k}"),
        ("<div class='one'>own {k}<div class='two'><p>{long}</p></div></div>", "own {k}\n\n{long}"),
        # a list that is the same on all pages is left behind
        ("<div class='links'><ul><li><a>Home</a></li><li>About</li></ul></div><div class='one'><p>{long}</p></div>", "{long}"),
        # all articles of a page, and its title outside them; a heading of the site isn't one
        ("<div class='a'><article><p>{long}</p></article></div><div class='b'><article><p>second {k}</p></article></div>", "{long}\n\nsecond {k}"),
        ("<h1>Site</h1><header><h1>Title {k}</h1><p>by</p></header><article><p>{long}</p></article>", "Title {k}\n\n{long}"),
        ("<main><h1>Title {k}</h1><article><p>{long}</p></article></main>", "Title {k}\n\n{long}"),
    ],
)
def test_nothing_of_an_article_is_left_behind(spark, body, want):
    values = [{"k": k, "long": " ".join(f"w{k}{j}" for j in range(60))} for k in range(4)]
    page = "<html><body><div class='top'><p>Welcome</p></div>%s<div class='bottom'>Imprint</div></body></html>" % body
    assert texts_of(spark, [page.format(**v) for v in values]) == [want.format(**v) for v in values]


def test_a_lead_that_some_pages_lack_stays(spark):
    page = "<body><div class='wrap'>%s<div class='entry'><p>story {0} {0}{0}</p></div></div></body>"
    got = texts_of(spark, [(page % ("<h1>Only here</h1>" if k == 2 else "")).format(k) for k in range(4)])
    assert got == [("Only here\n\n" if k == 2 else "") + f"story {k} {k}{k}" for k in range(4)]


@pytest.mark.parametrize(
    "page, want",
    [
        # names of what holds the article, and of its headings, sections and paragraphs
        ("<html><body class='post no-sidebar'><p>story {k}</p></body></html>", "story {k}"),
        ("<body class='sidebar' id='menu'><p>story {k}</p></body>", "story {k}"),
        ("<body><main class='content has-sidebar ad'><p>story {k}</p></main></body>", "story {k}"),
        ("<body><article class='comments'><h2 id='side-effects'>S {k}</h2><h2 id='related-work'>R {k}</h2><h2 class='ad'>A {k}</h2></article></body>", "S {k}\n\nR {k}\n\nA {k}"),
        ("<body><article><section id='discussion'><p>d {k}</p></section><p class='alert'>mind {k}</p><section id='login'>l {k}</section></article></body>", "d {k}\n\nmind {k}\n\nl {k}"),
        ("<body><div id='menu'><article><p>story {k}</p><div class='ad'>buy {k}</div></article></div></body>", "story {k}"),
        ("<body><div class='popup'><p>story {k}</p></div><div class='end'>Imprint</div></body>", "story {k}"),
        # what isn't an article goes whole, and what only may be none if it is the same on all pages
        ("<body><article><p>story {k}</p><div class='ad'>buy {k}</div><div class='x comments'>c {k}</div><div class='share'>Share this</div></article></body>", "story {k}"),
        ("<body><div class='one'><p>story {k}</p></div><div class='sidebar'>see {k}</div><div class='widget'>Hello</div></body>", "story {k}"),
    ],
)
def test_names_take_nothing_from_an_article(spark, page, want):
    assert texts_of(spark, [page.format(k=k) for k in range(3)]) == [want.format(k=k) for k in range(3)]


def test_names_on_a_host_of_one_page(spark):
    assert texts_of(spark, ["<body class='no-sidebar'><p>a</p><p class='alert'>b</p><div class='ad'>buy</div></body>"]) == ["a\n\nb"]
    assert texts_of(spark, ["<body><div class='modal'><p>a</p></div></body>"]) == ["a"]
    # a page that is there twice confirms nothing
    assert texts_of(spark, ["<body><p>a</p><p class='alert'>b</p></body>"] * 2 + ["<body><p>c</p></body>"]) == ["a\n\nb"] * 2 + ["c"]


def wrapper_of(pages):
    """The host's wrapper by folding its structures in order, without Spark."""
    known = {}
    for html in pages:
        stream, lows, highs = html_extract.structure(html)
        html_extract.add_structure(known, stream, 1, lows, highs)
    whole = None
    for stream, (n, lows, highs) in sorted(known.items()):
        wrapper = html_extract.read(stream, n if lows != highs else 1, lows, highs)
        if whole is None:
            whole = wrapper
        else:
            html_extract.merge(whole, wrapper)
    return html_extract.decide(html_extract.bound(whole))


def test_alignment_makes_options_and_repeats():
    both = wrapper_of(["<div><p>a</p><p>b</p><ul><li>x</li></ul></div>", "<div><h2>t</h2><p>c</p></div>"])
    flags = {c.sign: c.flags for c in both.kids[0].kids}
    assert flags == {"h2": html_extract.OPTIONAL, "p": html_extract.REPEATED, "ul": html_extract.OPTIONAL}
    # containers are compared one by one as long as their numbers agree, and are rounds of a group where they don't
    same = wrapper_of([f"<div>top</div><div>story {k}</div><div>end</div>" for k in range(3)])
    assert [(c.sign, c.flags & 7) for c in same.kids] == [("div", 0)] * 3
    more = wrapper_of(["<h2>t</h2>" + "<div>x</div>" * n for n in (1, 3, 2)])
    assert [(c.sign, bool(c.flags & html_extract.REPEATED)) for c in more.kids] == [("h2", False), ("div", True)]


def test_hostile_pages_take_linear_time():
    began = time.perf_counter()
    for html, want in [
        ("<div>" * 5000 + "x", "x"),
        ("<a" * 500_000, ""),
        ("<" + "a" * 1_000_000, ""),
        ("<p>x</p>" + "<a b=\"" * 100_000, "x"),
        ("<div>" * 5000 + "</section>" * 5000 + "x", "x"),
        ("<b>" * 50_000 + "<hr>" * 50_000 + "<p>x", "x"),
        ("<!--" * 100_000 + "x", ""),
        ("<p " + "class " * 50_000 + ">x", "x"),
        ("".join(f"<div class='q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}'>x</div>" for k in range(3000)), "\n\n".join(["x"] * 3000)),
    ]:
        assert html_extract.text_of(html, wrapper_of([html])) == want
        json.loads(html_extract.dump(wrapper_of([html, "<p>y</p>"])))
    assert time.perf_counter() - began < 30


def test_hostile_pages_in_spark(spark):
    pages = ["<div>" * 5000 + "x", "<a" * 100_000, "<p>" + "long " * 400_000, "<svg><text>in a picture</text></svg><math><mi>x</mi></math><button>press</button>"]
    rows = spark.createDataFrame([(k, f"http://h{k}/x", page) for k, page in enumerate(pages)], "page_id int, url string, html string")
    got = [r.text for r in html_extract.extract(rows).orderBy("page_id").collect()]
    assert got == ["x", "", ("long " * 400_000).strip(), "in a picturexpress"]


def planted(draw, host, k, depth):
    """A page of a made-up host, without article elements, and its article: template texts around it are the same on all
    pages, some parts are optional, and names mislead on some hosts."""
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    blocks = [f"Title {host} {k}", *(" ".join(word() for _ in range(draw.randint(3, 30))) for _ in range(draw.randint(1, 6)))]
    inner = f"<h1>{blocks[0]}</h1>" + "".join(draw.choice(["<p>{}</p>", "<p>{}", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>"]).format(x) for x in blocks[1:])
    names = [["content", "top", "bottom"], ["sidebar", "content", "main"], ["", "", ""], ["menu", "article", "story"]][host % 4]
    held, top, end = (f"<div class='{x}'>" if x else "<div>" for x in names)
    notice = "<div class='promo'>Sale ends soon</div>" if k % 3 == 0 else ""
    html = f"<html><head><title>t</title></head><body>{top}<p>Welcome to host {host}</p></div>{notice}" + "<div>" * depth + f"{held}{inner}</div>" + "</div>" * depth + f"{end}<p>Imprint of {host}</div></body></html>"
    return html, "\n\n".join(blocks)


def test_wrappers_find_planted_articles(spark):
    draw = random.Random(17)
    pages = [(host * 100 + k, host, *planted(draw, host, k, host % 3)) for host in range(12) for k in range(9)]
    rows = spark.createDataFrame([(i, f"http://host{h}.example/{i}", html) for i, h, html, _ in pages], "page_id int, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(rows.repartition(5)).collect()}
    assert got == {i: want for i, _, _, want in pages}
    # The wrapper decides: without it most pages give other texts.
    assert sum(html_extract.text_of(html, None) != want for _, _, html, want in pages) > 0.9 * len(pages)
    # Neither the order of rows nor partitions matter.
    wrappers = lambda df: sorted((r.host, r.wrapper) for r in html_extract.infer_wrappers(df).collect())
    assert wrappers(rows.repartition(7)) == wrappers(rows.orderBy(F.desc("html")).coalesce(2))


def test_the_wrapper_decides_on_given_pages(spark):
    """The given pages with their article elements made plain: the wrappers find the same texts."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    got = {r.page_id: r.text for r in html_extract.extract(plain).collect()}
    assert got == want
    alone = {r.page_id: html_extract.text_of(r.html, None) for r in plain.collect()}
    assert sum(alone[i] != want[i] for i in want) > 0.9 * len(want)


@pytest.mark.parametrize(
    "article",
    [
        "<article><div class='price alert'>a {k}</div><section id='related-work'>b {k}</section><p class='side'>c {k}</p></article>",
        "<article><math><mi>a {k}</mi></math><p>b {k} <button>c</button></p></article>",
        "<main><div class='ad-hoc'>a {k}</div><div id='comments-on-method'>b {k}</div><div class='menu-of-the-day'>c {k}</div></main>",
    ],
)
def test_names_alone_take_nothing(spark, article):
    for n in (1, 3):
        for k, text in enumerate(texts_of(spark, [article.format(k=k) for k in range(n)])):
            assert f"a {k}" in text and f"b {k}" in text and "c" in text
    # a name that one article of several has is part of it
    got = texts_of(spark, [f"<article><p>story {k}</p>" + ("<div class='menu'>soup and fish</div>" if k == 1 else "") + "</article>" for k in range(3)])
    assert got == ["story 0", "story 1\n\nsoup and fish", "story 2"]


# 10 mixing
def targets_brute(sizes, weights=mixing.WEIGHTS, most=mixing.MOST):
    w = np.array([weights[k % len(weights)] for k in range(len(sizes))], float)
    limit, out = most * np.array(sizes, float), np.zeros(len(sizes))
    left, open_ = float(sum(sizes)), np.array(sizes) > 0
    while open_.any():
        share = left * w / w[open_].sum()
        over = open_ & (share > limit)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = limit[over]
        left -= float(limit[over].sum())
        open_ &= ~over
    return out.tolist()


def sources_of(spark, sizes):
    """The table of sources of a mix of one document per source."""
    rows = [(k, " ".join(["w"] * n), None if k == len(sizes) - 1 else f"s{k:05}") for k, n in enumerate(sizes)]
    return mixing.Mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).sources


@pytest.mark.parametrize("sizes", [[], [0, 0], [100, 100, 100, 100], [10, 1000, 1000], [1, 2, 3, 5000, 40, 0, 7, 900, 11, 12], [37] * 50])
def test_targets(spark, sizes):
    rows = sources_of(spark, sizes).orderBy("s").collect()
    assert [r.source_size for r in rows] == sizes and [r.name is None for r in rows] == [k == len(sizes) - 1 for k in range(len(sizes))]
    assert [r.target for r in rows] == pytest.approx(targets_brute(sizes))
    assert sum(r.target for r in rows) == pytest.approx(sum(sizes))


def test_small_sources_come_near_their_targets(spark):
    sizes = [100, 130, 1000, 20_000, 40, 5]
    rows = [(k, " ".join(f"w{i}" for i in range(n)), f"s{k}") for k, n in enumerate(sizes)]
    for r in mixing.mix_counts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect():
        assert abs(r.taken - r.target) <= max(1, 0.02 * r.target) and r.taken <= 3 * r.size


def test_any_number_of_sources(spark):
    """Beyond the broadcast the table of sources is joined; the mix is the same."""
    rows = [(k, f"a b c {k}", f"s{k % 700}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = sorted(mixing.mix_counts(docs).collect())
    most, mixing.MOST_SOURCES = mixing.MOST_SOURCES, 10
    try:
        assert sorted(mixing.mix_counts(docs).collect()) == want
    finally:
        mixing.MOST_SOURCES = most
    assert abs(sum(r.taken for r in want) - sum(r.size for r in want)) < 0.05 * sum(r.size for r in want)


def test_permutation_and_deal():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 99 + n).tolist()) == list(range(n))
    dealt = mixing.deal(np.array([1000, 10, 0, 333]), mixing.even(1343, 16), 1)
    assert dealt.sum(axis=0).tolist() == [1000, 10, 0, 333] and (dealt >= 0).all() and dealt.shape == (16, 4)
    assert dealt.sum(axis=1).tolist() == mixing.even(1343, 16) and mixing.deal(np.array([], np.int64), [0, 0], 1).shape == (2, 0)


def test_mixing(spark, texts):
    docs = frame(spark, texts)
    rows = mixing.mix_counts(docs, block=16).collect()
    assert len(rows) == len(texts)
    assert sorted(r.size for r in rows) == sorted(len(SPACE.findall(t or "")) for _, t in texts)
    by_source = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        part = by_source[r.source_size]
        part[0], part[1], part[2] = r.source_size, r.target, part[2] + r.taken
    for size, target, taken in by_source.values():
        assert abs(taken - target) <= max(16, 0.1 * target)
    again = mixing.mix_counts(docs.repartition(5), block=16).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert mixing.mix_counts(docs.where("false")).count() == 0


def test_mixed_texts_hold_the_words_taken(spark, texts):
    docs = frame(spark, [(i, t) for i, t in texts if i != 60])
    counts = {r.doc_id: r.taken for r in mixing.mix_counts(docs, block=16).collect()}
    mixed = mixing.mix_texts(docs, block=16)
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(SPACE.findall(r.text))
        assert r.n_chars == len(r.text)
    assert mixed.columns == docs.columns and {i: n for i, n in counts.items() if n} == dict(got)


# Queries
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(SF, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, name):
    table = "pages" if name in ("op7_url_filters", "op9_html_extraction") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    assert QUERIES[name](spark, SF).select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def wide_pages(n, seed=1):
    """Pages of a host without article or main: a header, n blocks of differing elements, an imprint."""
    draw = random.Random(seed)
    pages = []
    for k in range(6):
        blocks = [(draw.choice(["p", "ul", "h2", "pre", "section", "div", "blockquote"]), f"page {k} block {b} {draw.random()}") for b in range(n)]
        body = "".join(f"<{t}><li>{x}</li></{t}>" if t == "ul" else f"<{t}>{x}</{t}>" for t, x in blocks)
        pages.append((f"<html><body><div class=top>My site</div>{body}<div class=legal>All rights reserved</div></body></html>", "\n\n".join(x for _, x in blocks)))
    return pages


@pytest.mark.parametrize("n", [40, 63, 70, 200, 511, 700, 3000])
def test_levels_of_any_width(n):
    """Header and imprint stay out and the article whole, whatever the number of blocks."""
    pages = wide_pages(n)
    wrapper = wrapper_of([html for html, _ in pages])
    assert len(html_extract.dump(wrapper)) < 400_000
    for html, want in pages:
        assert html_extract.text_of(html, wrapper) == want


def test_wide_levels_in_a_job(spark):
    pages = [(k, "http://h.org/x", html, want) for k, (html, want) in enumerate(wide_pages(900))]
    rows = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(rows.repartition(3)).collect()} == {k: want for k, _, _, want in pages}


def test_wrappers_of_very_many_elements_are_bounded():
    """A thousand elements a level, and levels below them: the ends of levels stay in order."""
    inner = "".join(f"<section>{''.join(f'<div><p>w{a}{b}</p></div>' for b in range(12))}</section><h2>t{a}</h2><ul><li>x</li></ul>" for a in range(400))
    pages = [f"<html><body><div class=top>My site</div>{inner}<p>last of {k}</p><div class=legal>Imprint</div></body></html>" for k in range(4)]
    pages = [html.replace("w1", f"v{k}").replace("t3", f"u{k}") for k, html in enumerate(pages)]
    wrapper = wrapper_of(pages)
    assert sum(1 for _ in html_extract.walk(wrapper)) < 2 * html_extract.NODES
    for k, html in enumerate(pages):
        text = html_extract.text_of(html, wrapper)
        assert "My site" not in text and "Imprint" not in text
        assert text.endswith(f"last of {k}") and f"v{k}" in text
