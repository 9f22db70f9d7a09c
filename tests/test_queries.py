"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tilewright.operators import geometry
from tilewright.plans import registry, repair_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    want = duck.execute(f"SELECT {columns} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(map(plain, r)) for r in found.collect()), key=key) == sorted((tuple(map(plain, r)) for r in want), key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_colours_of_keys_beyond_six_digits(spark, duck, tmp_path):
    spark.createDataFrame([(k, f"n{k}") for k in (1, 16_827, 16_828, 900_000, 5_000_000)], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    found = registry.QUERIES["X16_X17_K16_strings"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLE_SQL['X16_X17_K16_strings']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_joins_of_unfolded_tables_are_never_broadcast(spark):
    boxes = spark.createDataFrame([(1, k, k, k, k + 1, k + 1) for k in range(3)], "image_id long, id long, x1 long, y1 long, x2 long, y2 long")
    points = boxes.select("id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    for met in (geometry.overlapping(boxes, 16, ["image_id"]), geometry.within_distance(points, 3), geometry.grouped(points, geometry.within_distance(points, 3))):
        assert met.count() > 0 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_columns_are_unfolded_once(spark):
    plan = repair_queries._dense(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, line in enumerate(plan) if "Generate" in line)
    assert any("Aggregate [image_id" in line and "y#" not in line for line in plan[at : at + 3])
