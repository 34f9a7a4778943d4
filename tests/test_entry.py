import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query", "rank", "slug"] and df.count() > 0


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    """In a copy without them the entry falls back; a broken module in them is no reason to."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for gone in ("tessera/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "r" / gone, ignore_errors=True)
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True).returncode
    code = "import __spark_entry__ as e; n = e.queries(); assert 'related_pages' in n and 'pipeline' not in n and not any(k.startswith('op') for k in n)"
    assert run(code) == 0
    (tmp_path / "r/corpus_pipeline.py").unlink(missing_ok=True)
    assert run(code) == 0
    (tmp_path / "r/corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    assert run("import __spark_entry__") != 0
    (tmp_path / "r/corpus_pipeline.py").unlink()
    some = ["tests/test_text.py", "tests/test_catalogue.py::test_every_query_has_sql", "tests/test_catalogue.py::test_same_as_sql[current_filter]"]
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *some], cwd=tmp_path / "r", capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]
