"""Pair queries over ``part`` on tables whose pairs are too many to be made one by one, and on repeated and missing keys."""

import threading

import duckdb
import pytest

from reclink.plans import catalogue
from tests.test_queries import rows

ALL = round(5 * 99_999 / (99_999 + 4 * 199_999), 6)  # F0.5 of a part that guesses all parts of its name
COUNTED = {
    "threshold_choice": [(0.33, ALL)],
    "country_slices": [("B0", ALL, 100_000), ("B1", ALL, 100_000)],
    "recall_report": [(1.0, 1.0, 1.0, 1.0)],
    "macro_f05": [(ALL, round(99_999 / 199_999, 6), 1.0, 200_000)],
    "threshold_sweep": [(round(i / 20, 2), ALL) for i in range(1, 7)],
}
NAMED = ["feature_vector_core", "lr_score", "threshold_filter"]


def written(spark, path, found):
    spark.createDataFrame(found, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(COUNTED))
def test_pairs_are_counted_not_made(spark, tmp_path, name):
    """200,000 parts of one name, of two brands and three sizes: 40 billion pairs, cancelled after two minutes."""
    spark.range(200_000).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "concat('B', id % 2) AS p_brand", "'T' AS p_type", "CAST(id % 3 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    timer = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        found = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    finally:
        timer.cancel()
    assert found[: len(COUNTED[name])] == COUNTED[name]


@pytest.mark.parametrize("name", sorted(COUNTED) + NAMED)
def test_repeated_and_missing_keys_equal_sql(spark, tmp_path, name):
    """Keys on several rows, keys that are null, and (where SQL engines agree on them) null names, brands and sizes."""
    words, gone = ("gear", "ring", "red bolt", "red nut"), name in COUNTED
    found = [(i * 7 % 90 if i % 9 else None, words[i * i % 4] if i % 11 or not gone else None, f"B{i // 3 % 2}" if i % 13 else None, "T", i * 5 % 14 if i % 17 else None) for i in range(180)]
    found += found[:20]
    path = written(spark, tmp_path, found)
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{path}/part.parquet/*.parquet'")
    assert rows(catalogue.QUERIES[name](spark, path).toPandas()) == rows(con.execute(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", NAMED)
def test_features_are_computed_once_for_two_names(spark, name):
    """What is left for each pair of parts is a lookup."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "array_intersect" not in plan
