import os
import shutil
import subprocess
import sys

import pytest
from conftest import DATA, ROOT, same_as_sql

from lodestone.plans import registry


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE])
def test_query_equals_its_sql(spark, name):
    same_as_sql(spark, [name], registry.QUERIES, registry.ORACLE)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE])
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).columns


def test_all_else_works_without_the_text_package(tmp_path):
    """A copy without the text package and its tests still imports, names its queries and passes its other tests."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys() and 'p4_found' in e.queries() and 'p3_found' not in e.queries()"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "copy")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_codec.py", "tests/test_text.py", "tests/test_skew.py"], cwd=tmp_path / "copy", env=env, check=True, timeout=600)


def test_a_broken_text_package_is_not_hidden(tmp_path):
    """Only its absence is passed over; an import that fails within it is an error."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    (tmp_path / "copy/lodestone/llm").mkdir()
    (tmp_path / "copy/lodestone/llm/__init__.py").write_text("")
    (tmp_path / "copy/lodestone/llm/registry.py").write_text("import no_such_module\n")
    env = os.environ | {"PYTHONPATH": str(tmp_path / "copy")}
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "copy", env=env, timeout=120, capture_output=True).returncode
