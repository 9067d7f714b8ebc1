"""Every document query beside its SQL over the smallest tables, and what its plan may hold."""

import os

import duckdb
import pytest
from docweft.plans import file_queries, letter_queries, more_queries, stream_queries  # noqa: F401  registers its queries
from docweft.plans.queries import QUERIES, SQL
from verify_queries import canonical

AT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(AT), reason="the given tables are elsewhere")
PYTHON = {"text_error_rates", "word_error_corpus", "recognised_texts"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(AT):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{AT}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, AT)
    cols = sorted(df.columns)
    got = canonical([tuple(r) for r in df.select(*cols).collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "FlatMapGroups"))
    if name in SQL:
        sql = SQL[name].strip()
        rel = db.sql(sql)
        assert sorted(rel.columns) == cols
        assert got == canonical(db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql})").fetchall())
    else:
        assert name in PYTHON and got


def on_path(folder):
    """The environment of a child process: the folder first, then all that this process imports from but the repository itself."""
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    own = (root, os.path.join(root, "tests"), os.path.join(root, "tests", "llm"))
    rest = [p for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *sys.path] if p and os.path.abspath(p) not in own]
    return os.environ | {"PYTHONPATH": os.pathsep.join([str(folder), *dict.fromkeys(rest)])}


def test_entry_without_the_llm_folder(tmp_path):
    """The rest imports, lists its queries and has tests that need nothing else when the training-data folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for x in ("docweft", "tests", "__spark_entry__.py", "verify_queries.py"):
        src, dst = os.path.join(root, x), tmp_path / x
        shutil.copytree(src, dst, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, dst)
    code = "import re, __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q; assert not [n for n in q if re.match(r'op[0-9]+_', n)]; e.oracle_sql()"
    env = on_path(tmp_path)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-1500:]


def test_entry_hides_no_other_missing_module(tmp_path):
    """Only the left-out parts themselves may be missing; a module that they need and that is missing is an error."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "docweft"), tmp_path / "docweft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    (tmp_path / "docweft" / "llm").mkdir()
    (tmp_path / "docweft" / "llm" / "__init__.py").write_text("")
    (tmp_path / "docweft" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=on_path(tmp_path), capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_module_anywhere" in done.stderr
