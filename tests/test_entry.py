"""The driver's entry points, with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


@pytest.mark.skipif(not (ROOT / "quarryloom/llm").exists(), reason="already without it")
@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_stands_alone(tmp_path, pipeline):
    """The whole tree without the corpus subpackage, and then without the pipeline too."""
    gone = ["llm", "__pycache__", ".git", *([] if pipeline else ["corpus_pipeline.py"])]
    shutil.copytree(ROOT, tmp_path / "tree", ignore=shutil.ignore_patterns(*gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fetch_view_auto' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q), q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "tree", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "tree")}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_subpackage():
    for p in (ROOT / "quarryloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quarryloom.llm" not in p.read_text(), p


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["url", "mode_used", "error_code", "response"] and df.count() == 50
