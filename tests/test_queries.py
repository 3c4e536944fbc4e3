"""Every registered query against its SQL; and what happens without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

from sylvan.plans import queries as core
from tests.conftest import ROOT, SMALL, duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    assert rows_of(core.QUERIES[name](spark, SMALL)) == duck_rows(duck, core.SQL[name])


def test_every_query_has_sql():
    assert set(core.SQL) == set(core.QUERIES)


def test_entry_works_without_the_subpackage(tmp_path):
    """In a copy without it and its pipeline; any other missing module is an error."""
    for name in ("sylvan", "tests"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'sel_tag' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
    listed = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True)
    assert listed.returncode == 0 and "llm" not in listed.stdout
    if os.path.exists(f"{ROOT}/sylvan/llm"):
        code = "import sys; sys.modules['numpy'] = None; import __spark_entry__"
        assert "ModuleNotFoundError" in subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stderr


def test_null_and_empty_documents(spark):
    from sylvan.operators.corpus import Corpus

    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "<p>", "z")], "doc_id long, html string, kind string")
    c = Corpus.parse(df)
    assert sorted((str(r.doc_id), r.input_len, r.node_count) for r in c.documents.collect()) == [("1", 0, 1), ("2", 0, 1), ("None", 3, 2)]
    assert Corpus.parse(df.limit(0)).nodes.count() == 0
    assert c.count("p").count() == 3
