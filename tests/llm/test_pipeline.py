"""The stages, each on its own input."""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from quillgraph.llm import mixing, packing, quality_model
from quillgraph.llm.common import table
from tests.llm.test_operators import SPACE, components_brute, dedup_brute, frame, rows_brute, scores_brute, texts, words  # noqa: F401 - fixtures

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.mode("overwrite").parquet(path := str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(path)
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()} <= ids, name
        assert docs.count() > 0, name


def test_run_equals_stages(spark):
    rows = corpus_pipeline.run(spark, SF).orderBy("sequence_id", "offset").collect()
    assert rows == corpus_pipeline.run(spark, SF).orderBy("sequence_id", "offset").collect()


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows_in_order(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_quality_stage_keeps_what_scores_well(spark):
    """Against scores made document by document from the trained vectors and network, without Spark."""
    docs = table(spark, SF, "documents")
    vectors, model = quality_model.train(docs, table(spark, SF, "labels"))

    rows = docs.select("doc_id", "text").collect()
    _, lines = rows_brute([r.text for r in rows], quality_model.SIZE)
    sure = {r.doc_id: bool(s >= 0.3) for r, s in zip(rows, scores_brute(lines, vectors, model), strict=True) if abs(s - 0.3) > 1e-3}
    kept = {r.doc_id for r in stage("quality classifier")(spark, docs, SF).collect()}
    assert len(sure) > 0.9 * len(rows) and {i for i, good in sure.items() if good} == kept & set(sure)


def test_line_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = rows_in_order(docs)
    gone = dedup_brute(rows)
    want = []
    for i, t in rows:
        lines, n = [], 0
        for part in (t or "").split("\n"):
            if SPACE.search(part):
                lines += [part] if n not in gone.get(i, ()) else []
                n += 1
            else:
                lines.append(part)
        want.append((i, t if i not in gone else "\n".join(lines) if n > len(gone[i]) else ""))
    assert gone and rows_in_order(stage("line dedup")(spark, docs, SF)) == want


def test_near_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = rows_in_order(docs)
    firsts = {c for _, c in components_brute(rows).values()}
    assert len(firsts) < len(rows) and rows_in_order(stage("MinHash near-dedup")(spark, docs, SF)) == [r for r in rows if r[0] in firsts]


def test_mixing_stage_against_counts(spark):
    """The words of each document are taken as often as the mix says, in whole rounds through the document and one part."""
    docs = table(spark, SF, "documents")
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(docs).collect()}
    whole = {r.doc_id: Counter(SPACE.findall(r.text or "")) for r in docs.collect()}
    got, words = defaultdict(int), defaultdict(Counter)
    for r in stage("mixing")(spark, docs, SF).collect():
        found = SPACE.findall(r.text)
        got[r.doc_id] += len(found)
        words[r.doc_id].update(found)
        assert r.n_chars == len(r.text) and not Counter(found) - whole[r.doc_id]
    assert {i: n for i, n in taken.items() if n} == dict(got)
    for i, n in got.items():  # no word is taken more often than one round more than another
        rounds = [words[i][w] / c for w, c in whole[i].items()]
        assert max(rounds) - min(rounds) <= 1 + 1e-9


def test_packing_stage_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    docs = table(spark, SF, "documents")
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    place = defaultdict(int)
    for r in stage("packing")(spark, docs, SF).orderBy("doc_id", "start").collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == place[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        place[r.doc_id] += r.length
    assert place == {i: len(x) for i, x in ids.items()}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, texts, name):  # noqa: F811
    """Nulls in any column, empty and long texts, repeated rows, clashing names, an empty table."""
    docs = frame(spark, texts).select("*", *[F.lit(None).cast("string").alias(c) for c in ("word", "n", "start", "block", "queue", "host")])
    out = stage(name)(spark, docs, SF)
    assert name == "packing" or out.columns == docs.columns
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids and ids <= {i for i, _ in texts}
    assert stage(name)(spark, docs.where("false"), SF).count() == 0
