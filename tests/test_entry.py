"""The driver's entry module."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")


def test_imports_and_lists_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'all_reduce_sum' in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("missing", ["xxhash", "rankmesh.llm", "corpus_pipeline"])
def test_the_other_queries_stay_when_something_is_missing(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'all_reduce_sum' in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables aren't here")
def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["rank", "idx", "val"] and df.count() == 1500
