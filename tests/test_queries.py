"""Each query of the engine against the SQL it is checked with, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from reclink.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").count() >= 0


def test_oversized_keys_keep_their_candidates(spark, tmp_path):
    """One name 600 times in a source and language (and once in another): no key is left out for its size."""
    rows = [(i, "copied name of one record" if i < 1803 else f"other {i} words", "en" if i < 1800 else "fr") for i in range(1806)]
    for table in ("documents", "part"):  # part is opened for its name in "party"
        spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / f"{table}.parquet"))
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path))
    joined = run("exact_key_join").groupBy("bucket").count().collect()
    assert sorted(map(tuple, joined)) == [(1, 2), (600, 600 * 1200)]
    top = run("lsh_vote_topk").where("q = 3").collect()
    assert sorted((r["source"], r["rk"], r["rid"], r["votes"]) for r in top) == sorted((s, k + 1, 3 * k + s - 1, 8) for s in (2, 3) for k in range(30))
    assert run("lsh_vote_topk").where("q < 1800").count() == 600 * 60
    assert sorted(tuple(r) for r in run("cross_country_rescue").where("q in (3, 1800)").collect()) == [(3, 1801, 8), (3, 1802, 8)] + [(1800, i, 8) for i in (1, 2, 4, 5, 7)]
