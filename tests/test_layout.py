"""The training-data operators can be taken away: nothing else in the library imports them."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_llm_subpackage():
    outside = [p for p in (TOP / "quillgraph").rglob("*.py") if "llm" not in p.relative_to(TOP / "quillgraph").parts]
    assert outside and not [p for p in outside if "quillgraph.llm" in p.read_text()]


def test_entry_works_without_it(tmp_path):
    for p in (TOP / "quillgraph").rglob("*.py"):
        inner = p.relative_to(TOP)
        if "llm" not in inner.parts:
            (tmp_path / inner).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / inner).write_text(p.read_text())
    (tmp_path / "__spark_entry__.py").write_text((TOP / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100 and not [n for n in q if n.startswith('op1_') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)
