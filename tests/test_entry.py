"""The contract's module without its optional part, and with a broken one."""

import shutil
import subprocess
import sys

from tests.conftest import ROOT


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


def copied(tmp_path):
    target = tmp_path / "copy"
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    return target


def test_without_the_optional_part(tmp_path):
    folder = copied(tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k == 'pipeline' or k[:2] == 'op' and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert run(folder, code).returncode == 0
    (folder / "lodestone" / "llm" / "__pycache__").mkdir(parents=True)
    assert run(folder, code).returncode == 0


def test_a_broken_part_is_an_error(tmp_path):
    folder = copied(tmp_path)
    (folder / "corpus_pipeline.py").write_text("from lodestone.llm import queries\n")
    (folder / "lodestone" / "llm").mkdir()
    (folder / "lodestone" / "llm" / "__init__.py").write_text("")
    (folder / "lodestone" / "llm" / "queries.py").write_text("import no_such_package\n")
    out = run(folder, "import __spark_entry__")
    assert out.returncode and "no_such_package" in out.stderr
