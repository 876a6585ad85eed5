import duckdb
import pytest

from tests.conftest import SF
from yardmaster.plans import more_queries  # noqa: F401  it registers its queries
from yardmaster.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_scans_stay_in_the_engine(spark):
    from yardmaster.operators import store

    slots = spark.read.parquet(f"{SF}/part.parquet").withColumnRenamed("p_size", "Cpus")
    plan = store.run_query(slots, store.Query("Cpus > 45", ("p_name",)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,45)" in plan and "p_brand" not in plan and "Python" not in plan


def test_equalities_become_join_keys(spark):
    from yardmaster.operators import matching

    jobs = spark.createDataFrame([(1, "X86", 4)], "request_id long, Want string, Cpus long")
    slots = spark.createDataFrame([(1, "x86", 8)], "ScanIndex long, Arch string, Cpus long")
    pairs = matching.bilateral(jobs, slots, "TARGET.Arch == MY.Want && TARGET.Cpus >= MY.Cpus")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_module_names_agree():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
