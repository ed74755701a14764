"""Exact duplicates, spelling variants and collocations against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import collocations, exact_dedup, spelling
from quillgraph.llm.queries import ORACLES, QUERIES
from tests.compare import rows_of, rows_of_sql
from tests.llm.test_operators import frame, texts, words  # noqa: F401 - fixtures

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id bigint, group_size string, kept boolean, text_sha256 string, n int, word string, id long"


def documents(spark, rows):
    """Rows (doc_id, text, lang) under columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", None, 7, "x", True, "y", 1, "z", 5) for i, t, lang in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_spelling_variants", "op13_collocations"])
def test_query(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(SF, ORACLES[name])


# 11 exact duplicates
def marks_brute(rows):
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, at))
    out = []
    for h, members in groups.items():
        stay = min(members)
        out += [(m[2] if not m[1] else None, stay[2] if not stay[1] else None, len(members), m == stay, h) for m in members]
    return Counter(out)


def test_marks(spark, texts):  # noqa: F811
    rows = [*texts, (90, " "), (91, "\t\n\x0b\x0c\r"), (92, "\xa0"), (93, "one"), (94, " o n e "), (95, "o\nn e "), (96, "x" * 50_000 + " "), (None, "one"), (60, texts[-1][1])]
    found = exact_dedup.mark(documents(spark, [(i, t, "en") for i, t in rows]))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == marks_brute(rows)


def test_marks_nothing(spark):
    assert exact_dedup.mark(documents(spark, [])).count() == 0
    assert exact_dedup.keep_one(documents(spark, [])).count() == 0


def test_keep_one_keeps_columns_and_one_row_of_each(spark, texts):  # noqa: F811
    rows = [*texts, (90, " "), (94, " o n e "), (None, "one"), (60, texts[-1][1])]
    table = documents(spark, [(i, t, "en") for i, t in rows])
    kept = exact_dedup.keep_one(table)
    assert kept.columns == table.columns
    wanted = sorted((str(k[1]), k[4]) for k in marks_brute(rows) if k[3])
    bare = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    assert sorted((str(r["doc_id"]), bare(r["text"])) for r in kept.collect()) == wanted


def test_one_text_with_a_third_of_all_rows(spark):
    rows = [(i, "same text " * 5 if i % 3 else f"text {i}") for i in range(3000)]
    found = exact_dedup.mark(documents(spark, [(i, t, "en") for i, t in rows]))
    assert Counter(tuple(r) for r in found.collect()) == marks_brute(rows)


def test_a_full_filter_changes_nothing(spark, texts, monkeypatch):  # noqa: F811
    rows = [(i, t, "en") for i, t in texts] + [(1000 + k, f"only {k}", "en") for k in range(500)]
    wanted = Counter(tuple(r) for r in exact_dedup.mark(documents(spark, rows)).collect())
    monkeypatch.setattr(exact_dedup, "BLOCK", 32)  # a block of 32 bits: all of them are set more than once
    monkeypatch.setattr(exact_dedup, "MOST_BLOCKS", 1)
    assert Counter(tuple(r) for r in exact_dedup.mark(documents(spark, rows)).collect()) == wanted


def test_the_filter_lets_few_single_rows_through(spark):
    keys = exact_dedup.keyed(documents(spark, [(i, f"text number {i // 2 if i < 200 else i}", "en") for i in range(20_000)])).select("_qg_id", "_qg_hash", "_qg_chars")
    blocks = exact_dedup.blocks_for(20_000)
    found = exact_dedup.maybe_repeated(keys, exact_dedup.repeated_bits(keys, blocks), blocks).where("_qg_maybe")
    ids = {r[0] for r in found.select("_qg_id").collect()}
    assert ids >= set(range(200))
    assert len(ids) < 200 + 0.02 * 20_000


def test_exact_dedup_has_no_python_in_its_plan(spark):
    found = exact_dedup.mark(documents(spark, [(1, "a", "en"), (2, "a", "en")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


# 12 spelling variants
def words_brute(rows):
    counts = Counter()
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :])


def variants_brute(counts):
    form, number = {}, {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        number[w] = len(around)
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], number[w], counts[form[w]] if form[w] else None))
    return out


def spelled(seed):
    """Texts of words that differ by a letter, with runs of one letter, chains of forms and letters beyond ASCII."""
    draw = random.Random(seed)
    base = ["".join(draw.choice("aabcdé") for _ in range(draw.randint(6, 8))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ÀÿÀÿÀÿ×÷", "abababab"]
    pool = []
    for w in base:
        family = {w}
        for _ in range(12):
            x = draw.choice(sorted(family))
            at = draw.randrange(len(x))
            family.add(draw.choice([x[:at] + x[at + 1 :], x[:at] + draw.choice("abé") + x[at:], x[:at] + draw.choice("abcé") + x[at + 1 :]]))
        for x in sorted(family):
            pool += [x] * (5 ** draw.randint(0, 3) * draw.choice([1, 2]))
    draw.shuffle(pool)
    return [(k, " ".join(w.upper() if draw.random() < 0.2 else w for w in pool[at : at + 40])) for k, at in enumerate(range(0, len(pool), 40))]


@pytest.mark.parametrize("part", [50_000, 7])
def test_variants(spark, part, monkeypatch):
    monkeypatch.setattr(spelling, "PART", part)  # small parts: many boundaries
    monkeypatch.setattr(spelling, "LETTERS", 64 if part > 7 else 3)
    rows = [*spelled(part), (None, "nullid " * 6), (None, None), (900, ""), (901, " ".join(["word" + "x" * 3000] * 6 + ["word" + "x" * 2999] * 30)), (902, "short runs of it " * 10), (902, "repeated " * 7), (902, "repeated " * 7)]
    counted = spelling.words(documents(spark, [(i, t, "en") for i, t in rows]))
    assert {tuple(r) for r in counted.collect()} == set(words_brute(rows).items())
    found = spelling.variants(counted)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == variants_brute(words_brute(rows))
    assert found.count() == len(words_brute(rows))


def test_a_word_loses_a_letter_by_its_hash(spark):
    rows = [(i, "collocation") for i in range(20_000)]
    counts = words_brute(rows)
    assert len(counts) > 1
    assert {tuple(r) for r in spelling.words(documents(spark, [(i, t, "en") for i, t in rows])).collect()} == set(counts.items())


def test_no_words(spark):
    assert spelling.variants(spelling.words(documents(spark, []))).count() == 0
    assert spelling.variants(spelling.words(documents(spark, [(1, None, "en"), (2, "a b", None)]))).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 40)], "id bigint, to bigint")
    assert {tuple(r) for r in spelling.roots(chain).collect()} == {(k, 0) for k in range(1, 40)}


# 13 collocations
def grams_brute(rows, most=5):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, most + 1):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i : i + m])] += 1
    return f, n


def collocations_brute(rows, least, top=2000):
    out = set()
    f, n = grams_brute(rows)
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in often.items():
            if any(b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items() if len(q) > len(p)):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def spoken(seed, langs=("en", "de", None)):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcé") for _ in range(draw.randint(1, 3))) for _ in range(15)] + ["a", "b", "Zoë", "it's", "-"]  # noqa: F811
    phrases = [" ".join(draw.choice(words) for _ in range(draw.randint(2, 6))) for _ in range(6)]
    rows = []
    for k in range(120):
        parts = [draw.choice(phrases) if draw.random() < 0.4 else draw.choice(words) for _ in range(draw.randint(0, 40))]
        rows.append((k, "".join(p + draw.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "; ", " ? "]) for p in parts), langs[k % len(langs)]))
    return rows


@pytest.mark.parametrize("shard", [1 << 19, 700, 23])
def test_collocations(spark, shard):
    rows = [*spoken(shard), (500, None, "en"), (501, "", "en"), (502, " \n.,", "en"), (503, "a b c a b c a b c a b c " * 30, "en"), (504, "same " * 300, "de"), (505, "only one language", "xx"), (505, "only one language", "xx"), (506, "und", "und")]
    found = collocations.collocations(documents(spark, rows), least=8, shard=shard)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == collocations_brute(rows, 8)
    assert found.count() == len(collocations_brute(rows, 8))


def test_only_the_first_phrases_of_a_language(spark):
    rows = spoken(5)
    assert {tuple(r) for r in collocations.collocations(documents(spark, rows), least=4, top=10).collect()} == collocations_brute(rows, 4, 10)


def test_no_collocations(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(1, None, None), (2, "one two", "en")])).count() == 0


def test_levels_count_every_phrase():
    draw = np.random.default_rng(3)
    ids = np.concatenate([draw.integers(0, 5, 4000).astype(np.int32), np.zeros(1, np.int32)])
    order = collocations.context_order(ids)
    keys = draw.integers(0, 1 << 63, 5).astype(np.uint64)
    counts, texts = [], [[()]]  # noqa: F811
    for word, tail, _, n in collocations.levels(ids[order - 1], np.ones(len(ids), bool), keys, 5, lambda d, h: np.ones(len(h), bool)):
        texts.append([(w, *texts[-1][t]) for w, t in zip(word.tolist(), tail.tolist(), strict=True)])
        counts.append(dict(zip(texts[-1], n.tolist(), strict=True)))
    for m in range(1, 6):
        wanted = Counter(tuple(ids[i : i + m].tolist()) for i in range(len(ids) - m + 1) if 0 not in ids[i : i + m])
        assert counts[m - 1] == wanted


def test_scores_pass_64_bits(spark):
    one = spark.sql("select 5000000000000L a, 9000000000000000L n, 7000000000000L l, 8000000000000L r")
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    assert one.select(score).first()[0] == 1000 * 5000000000000 * 9000000000000000 // (7000000000000 * 8000000000000)
