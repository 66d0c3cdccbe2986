import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_without_the_text_operators(tmp_path):
    """The entry module and its graph queries load when the llm folders and corpus_pipeline.py are gone."""
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['loomgraph.llm'] = None;"
        "import __spark_entry__ as e; q = e.queries(); assert 'gq01_validate_claims' in q and 'pipeline' not in q;"
        "assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_llm():
    for path in (ROOT / "loomgraph").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"loomgraph\.llm|import llm|corpus_pipeline", path.read_text()), path


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
