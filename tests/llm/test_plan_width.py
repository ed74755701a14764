"""How many exchanges and broadcasts the plans of the pipeline's joins have: the driver holds those of a plan at the same time."""

import re

from quillgraph.llm import mixing, near_dedup


def width(df) -> int:
    """Exchanges and broadcasts of the plan as first made."""
    return len(re.findall(r"\b(?:Broadcast)?Exchange\b", df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()))


def test_blocks_of_members(spark):
    block, near_dedup.BLOCK = near_dedup.BLOCK, 8
    try:
        # Hub 1: a component of 20 (blocks of its own), two of 3 (shared ones); hub 2: components of 9 and 17; hub 3: of 2 and 1.
        sizes = {(1, 10): 20, (1, 40): 3, (1, 50): 3, (2, 100): 9, (2, 120): 17, (3, 200): 2, (3, 210): 1}
        rows = [(hub, low + k, low) for (hub, low), n in sizes.items() for k in range(n)]
        got = near_dedup.blocked(spark.createDataFrame(rows, "hub long, doc_id long, component long"))
        assert width(got) <= 24, width(got)
        seen, groups = got.collect(), {}
        for r in seen:
            assert r.side in (r.i, r.j)
            groups.setdefault((r.hub, r.i, r.j), []).append(r)
        assert len({(r.hub, r.i, r.j, r.doc_id) for r in seen}) == len(seen)
        met = {(r.hub, *sorted((r.doc_id, s.doc_id))) for g in groups.values() for r in g for s in g if {r.side, s.side} == {r.i, r.j}}
        wanted = {(h, a, b) for h, a, x in rows for g, b, y in rows if h == g and a < b and x != y}
        assert wanted <= met
    finally:
        near_dedup.BLOCK = block


def test_places_of_documents_in_a_mix(spark):
    rows = [(k, f"word{k} " * (k % 7), "en", "abc"[k % 3], k) for k in range(60)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert width(mix.parts()) == 0
    assert mix.parts().selectExpr("sum(high - low)").first()[0] == sum(k % 7 for k in range(60))
