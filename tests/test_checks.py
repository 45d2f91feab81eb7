"""Every registered query gives the rows of its SQL."""

import pytest

from checks import all_checks
from checks.run import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", list(all_checks()))
def test_query_matches_sql(spark, con, key):
    verdict, _ = compare(spark, con, SMALL, key)
    assert verdict in ("ok", "no sql")


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns[0] == "Ambiente"


def test_entry_works_without_the_corpus_operators(tmp_path):
    """With lectern/llm and tests/llm deleted, the pipeline's file staying, all other queries are handed out."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("lectern", "checks", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(all_checks()) and int(out[1]) <= int(out[0])
