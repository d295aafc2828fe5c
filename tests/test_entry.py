import subprocess
import sys

import __spark_entry__
from tidemark import catalog

from .conftest import ROOT


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registered_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries) and set(oracles) <= set(queries)


def test_works_without_the_optional_parts():
    hide = "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.QUERIES), len(e.oracle_sql()) > 100)"
    assert subprocess.run([sys.executable, "-c", hide], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip() == "True True"
