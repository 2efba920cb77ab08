"""Every query of the library runs, and agrees with its SQL."""

import duckdb
import pytest

from compare import duck, duck_rows, spark_rows
from lectorium.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    names, rows = duck_rows(con, ORACLES[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == rows


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_css_looks_broadcast_no_rules_and_read_sheets_once(spark):
    plan = QUERIES["q_css_looks"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # their number is not seen in the size of the table
    assert plan.count("pythonUDF0") and plan.count("ArrowEvalPython") == 2  # the sheets and the elements' own styles


def test_sound_files_as_the_sql_orders_them_without_orders(spark, tmp_path):
    lines = [(1, 1, 1000006), (1, 2, 3), (2, 1, 1), (2, 2, 4)]  # order 1 has two formats with one file each
    spark.createDataFrame([(o, n, p, 2.0) for o, n, p in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2, 1, "x"), (2, 1, "x")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    rows = spark_rows(QUERIES["q_sound_files"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert len(rows) == 2 and rows == duck_rows(con, ORACLES["q_sound_files"])[1]


def test_decode_finds_texts_that_say_nothing_or_mislead(spark, tmp_path):
    texts = ["E.", "ernc", "zz " * 40, "a" + " " * 500, "", None, "\u0130\u212a x", "ppp" * 300]
    rows = [(k - 6, texts[k // 6 % len(texts)]) for k in range(6 * len(texts) + 6)] + [(None, "q")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(QUERIES["q_decode"](spark, str(tmp_path))) == duck_rows(con, ORACLES["q_decode"])[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.queries().keys() >= QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
