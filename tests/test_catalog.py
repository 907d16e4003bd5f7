"""Every query of the engine against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__ as entry
from simquarry.plans import catalog
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, name):
    assert spark_rows(catalog.QUERIES[name](spark, data)) == sql_rows(catalog.SQL[name], data)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"aligned_diff"}


def test_whole_tables(spark, data):
    run = lambda name: catalog.QUERIES[name](spark, data)
    built = run("id_parse_build")
    assert built.count() == spark.read.parquet(f"{data}/orders.parquet").count()
    assert not built.where("sid like 'idx:main:sim:jaccard:idx:main:func:9%:idx:main:func:9:1'").isEmpty()
    assert not built.where("sid like 'idx:main:sim:jaccard:idx:main:func:9:1:%'").isEmpty()
    assert run("index_status_missing").first()["num_sim_meta"] == run("canonical_pairs").count()
    assert run("storage_breakdown").where("component = 'pages'").first()["total_size"] > spark.read.parquet(f"{data}/pages.parquet").selectExpr("sum(octet_length(html))").first()[0]


def test_display_of_large_keys(spark, tmp_path):
    """The sizes of keys from 131,072 on pass 1,024 GB, which the SQL shows in GB."""
    spark.sql("SELECT k AS o_orderkey, 7L AS o_custkey, 'O' AS o_orderstatus, DATE'1995-01-02' AS o_orderdate FROM VALUES (1L), (131071L), (131072L), (900001L) AS t(k)").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "orders.parquet")
    assert spark_rows(catalog.QUERIES["display_expressions"](spark, str(tmp_path))) == sql_rows(catalog.SQL["display_expressions"], str(tmp_path))


@pytest.mark.parametrize("name", ["token_classes", "token_tips"])
def test_unnested_tables_are_not_broadcast(spark, data, name):
    """Their size is known only from the nested file's."""
    assert "Broadcast" not in catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
