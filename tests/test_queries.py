"""Every registered query of the library against its oracle SQL, over the smallest test tables."""

import math
import re

import duckdb
import pytest

from gneiss import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, float):
        return f"{x:.6f}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    got = sorted(tuple(plain(r[c].replace(tzinfo=None) if hasattr(r[c], "tzinfo") else r[c]) for c in order) for r in rows)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["path", "changes", "recent_changes", "score", "authors", "bug_fixes"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    from gneiss.session import ROOT

    shutil.copytree(f"{ROOT}/gneiss", tmp_path / "gneiss", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hotspots' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.fixture(scope="module")
def many_files(tmp_path_factory):
    """A star schema of 12,000 files, most of them without a recent change."""
    folder = tmp_path_factory.mktemp("many")
    con = duckdb.connect()
    source = "/root/testdata/sf0.01"
    for t in TABLES:
        rows = f"SELECT * FROM '{source}/{t}.parquet'"
        if t == "part":
            rows = f"SELECT * EXCLUDE (i) REPLACE (p_partkey + i * 2000 AS p_partkey) FROM '{source}/part.parquet', range(6) r(i)"
        if t == "lineitem":
            rows = f"SELECT * EXCLUDE (i) REPLACE (l_partkey + i * 2000 AS l_partkey) FROM '{source}/lineitem.parquet', range(6) r(i) WHERE l_linenumber = 1"
        con.execute(f"COPY ({rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    return con, str(folder)


def _same_as_sql(spark, many_files, name):
    con, folder = many_files
    df = catalog.queries()[name](spark, folder)
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
    return want


def test_key_areas_of_many_files(spark, many_files):
    assert many_files[0].execute("SELECT count(DISTINCT l_partkey) FROM lineitem").fetchone()[0] > 10_000
    assert len(_same_as_sql(spark, many_files, "key_areas")) == 10


def test_onboarding_of_many_files(spark, many_files):
    assert len([r for r in _same_as_sql(spark, many_files, "onboard_answer") if "key-areas" in r]) == 10


@pytest.mark.parametrize(("name", "most"), [("areas", 2), ("area_owners", 2), ("needs_help", 2), ("good_first_areas", 0), ("can_i_help_answer", 0), ("active_areas", 1), ("community_health", 1)])
def test_directories_come_out_of_one_pass_over_the_changes(spark, sf_dir, name, most):
    """The changes are read once, and once for the deletions or the pairs, or have been read when a table was written."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) <= most
