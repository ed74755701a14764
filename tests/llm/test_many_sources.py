"""Packing with ten thousand sources: every id is in one piece, sequences have no gaps, small sources spread over the windows."""

from __future__ import annotations

from collections import defaultdict

from quillgraph.llm import packing


def test_ten_thousand_sources(spark):
    rows = [(k, f"s{k}", " ".join(f"w{k % 97}" for _ in range(40 + k % 30))) for k in range(10_000)] + [(20_000 + k, "large", "one two three " * 400) for k in range(100)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(8)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length, r.doc_id))
    assert set(by_doc) == {r[0] for r in rows}
    for pieces in by_doc.values():
        at = 0
        for start, length, _ in sorted(pieces):
            assert start == at
            at += length
        assert at == pieces[0][2]
    whole = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        whole += at == packing.LENGTH
    assert sorted(by_sequence) == list(range(len(by_sequence))) and len(by_sequence) - whole <= 12
    # The small sources share one queue: their part of a window is near their part of all ids, window after window.
    ids = sum(length for pieces in by_sequence.values() for _, length, _ in pieces)
    large = sum(length for pieces in by_sequence.values() for _, length, d in pieces if d >= 20_000) / ids
    held = 0
    for k in range(whole):
        held += sum(length for _, length, d in by_sequence[k] if d >= 20_000)
        assert abs(held - large * packing.LENGTH * (k + 1)) <= 2 * packing.QUANTUM
