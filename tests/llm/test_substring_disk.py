"""What substring dedup shuffles and keeps on disk: each window once, and no step keeps what steps before it shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from reclink.llm import common, substring_dedup


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    jsc = spark.sparkContext._jsc.sc()
    jsc.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = jsc.statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_windows_are_shuffled_once(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    _, ranges = substring_dedup.repeated_ranges(docs)
    path = next(p for p in reversed(common._WRITTEN) if "/stretch-windows-" in p)
    windows = spark.read.parquet(path).where("kind = 1").count()
    before = shuffled(spark)
    assert ranges.count() > 0
    assert 0.9 * windows < shuffled(spark) - before < 1.5 * windows  # twice before: for the sums, and to join them back


def test_each_step_lets_go_of_those_before(spark, monkeypatch):
    """Shuffle files stay until the driver collects its garbage, so it does that once a step (never before)."""
    docs, calls, collect = common.table(spark, "/root/testdata/sf0.001", "documents"), [], common.gc.collect
    monkeypatch.setattr(common.gc, "collect", lambda *a: calls.append(a) or collect(*a))
    written = len(common._WRITTEN)
    assert substring_dedup.remove_repeats(docs).count() > 0
    assert len(calls) == len(common._WRITTEN) - written > 0


@pytest.mark.parametrize("heavy", [1, common.HEAVY, 1 << 40])
def test_frequent_windows_are_judged_alike(spark, monkeypatch, heavy):
    rng = random.Random(5)
    rows = [(7, -7, 10 + i % 300, 1000 + i, 4) for i in range(600)] + [(7, 8, 500 - i, i, 1) for i in range(40)]
    rows += [(rng.randrange(30), rng.randrange(3), rng.randrange(50), rng.randrange(90), i) for i in range(300)] + [(90 + i, 1, i, i, 0) for i in range(50)]
    least = {}
    for u1, u2, doc, _, _ in rows:
        least[u1, u2] = min(doc, least.get((u1, u2), doc))
    want = sorted((name, at) for u1, u2, doc, name, at in rows if doc > least[u1, u2])
    given = spark.createDataFrame(rows, "u1 long, u2 long, doc_id long, name long, at long").repartition(5)
    dealt, join = [], substring_dedup.salted_join
    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(substring_dedup, "salted_join", lambda r, *a: dealt.append(r) or join(r, *a))
    got = substring_dedup.judged_windows(given)
    assert got.columns == ["name", "at"] and sorted(map(tuple, got.collect())) == want
    assert (dealt[0].where(F.expr("u1 = 7 and u2 = -7")).count() == 600) == (heavy > 1)
