"""Sources, sinks and stores on small files, with the inputs that must be refused."""

import gzip

import pytest
from pyspark.sql import functions as F

from reclink.functions import records
from reclink.functions.dialect import SPARK
from reclink.plans.catalogue import over
from reclink.sources import scratch, stores, tsv

HEADER = "\t".join(["entity_id", "country", *records.FIELDS])


def row(i, source=2, **more):
    values = dict.fromkeys(["country", *records.FIELDS], "") | {"country_norm": "US", "name_sorted": f"n{i}", "addr_house": "1"} | more
    return "\t".join([f"S{source}-{i}", *values.values()])


def test_raw_rows_by_position(spark, tmp_path):
    """Further fields are dropped, short rows are left out, and any first line is the header, also behind a mark."""
    (tmp_path / "a.tsv").write_text('﻿id\tname\taddr\tland\nS1-1\tA "q"\tx\tUS\nS1-2\tB\t\tIN\textra\nS1-3\tshort\n', encoding="utf-8")
    path = str(tmp_path / "a.tsv")
    assert sorted(map(tuple, tsv.read_table(spark, path).collect())) == [("S1-1", 'A "q"', "x", "US"), ("S1-2", "B", "", "IN")]
    assert [r[0] for r in tsv.malformed(spark, path).collect()] == ["S1-3\tshort"]


def test_ground_truth_is_checked(spark, tmp_path):
    head = "source1_entity_id\tmatched_entity_ids\n"
    for k, (text, good) in enumerate([(head + "S1-1\tS2-1,S3-1\nS1-2\t\n", True), (head + "S1-1\tS2-1,S2-1\n", False), (head + "S1-1\tS1-2\n", False), (head + "S2-1\t\n", False), (head + "S1-1\n", False), ("a\tb\nS1-1\t\n", False)]):
        (tmp_path / f"{k}.tsv").write_text(text)
        if good:
            lists = tsv.read_lists(spark, str(tmp_path / f"{k}.tsv"), check=True)
            assert sorted(map(tuple, lists.collect())) == [("S1-1", ["S2-1", "S3-1"]), ("S1-2", [])]
            assert [r[0] for r in tsv.first_clusters(lists, 5).collect()] == ["S1-1"] and tsv.first_clusters(lists, 5, singletons=True).count() == 2
        else:
            with pytest.raises(ValueError):
                tsv.read_lists(spark, str(tmp_path / f"{k}.tsv"), check=True)


def test_parts_and_records(spark, tmp_path):
    for k, lines in enumerate([[HEADER, row(1), row(2)], [row(3)], [HEADER, row(4)]]):
        with gzip.open(tmp_path / f"train_source2.part-{k:02d}.tsv.gz", "wt") as f:
            f.write("\n".join(lines) + "\n")
    (tmp_path / "train_source3.tsv").write_text(f"{HEADER}\n{row(9, 3)}\n")
    parts = tsv.source_parts(spark, str(tmp_path), "train", 2)
    got = tsv.read_records(spark, parts, 2)
    assert sorted(r["entity_id"] for r in got.collect()) == ["S2-1", "S2-2", "S2-3", "S2-4"] and got.columns == HEADER.split("\t")
    assert stores.check_parts({"s2": got}, {"s2": 4}, got.columns) == [] and stores.check_parts({"s2": got}, {"s2": 5}, got.columns) == ["s2: 4 rows, 5 expected"]
    with pytest.raises(ValueError):
        tsv.read_records(spark, parts, 3)
    with pytest.raises(FileNotFoundError):
        tsv.source_parts(spark, str(tmp_path), "test", 2)
    s3 = tsv.read_records(spark, tsv.source_parts(spark, str(tmp_path), "train", 3))
    table = stores.build_records(got.where("entity_id <> 'S2-3'"), s3)
    assert [(r["rid"], r["entity_id"]) for r in table.orderBy("rid").collect()] == [(1, "S2-1"), (2, "S2-2"), (3, "S2-4"), (4, "S3-9")]
    assert [tuple(r) for r in stores.country_codes(table).collect()] == [("us", 1)]
    lists = spark.createDataFrame([("S1-1", ["S2-1", "S3-9"])], "source1_entity_id string, candidate_entity_ids array<string>")
    assert stores.build_fields(table, lists).count() == 2 and stores.fetch(table, spark.createDataFrame([("S2-1",)], "entity_id string")).count() == 1
    for bad in (lambda: stores.build_fields(table, lists.withColumn("candidate_entity_ids", F.array(F.lit("S2-77")))), lambda: stores.fetch(table, spark.createDataFrame([("S2-77",)], "entity_id string"))):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "train_source2.part-01.tsv.gz").unlink()
    with pytest.raises(ValueError):
        tsv.source_parts(spark, str(tmp_path), "train", 2)


def test_bad_headers(spark, tmp_path):
    for k, lines in enumerate([["entity_id\tx", "S2-1\t"], [HEADER, row(1) + "\tmore"], [HEADER + "\tentity_id", row(1) + "\t"]]):
        (tmp_path / f"{k}.tsv").write_text("\n".join(lines) + "\n")
        with pytest.raises(ValueError):
            tsv.read_records(spark, str(tmp_path / f"{k}.tsv"))


def test_normalised_sink_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("S2-1", 'Acme "x" Pvt Ltd', "1 Main St\tb, Peoria, IL", "usa")], "entity_id string, name string, address string, country string")
    out = over(spark, records.normalized(SPARK, "rec AS (SELECT * FROM raw)"), raw=raw)
    tsv.write_table(out, str(tmp_path / "out"))
    back = tsv.read_records(spark, sorted(str(p) for p in (tmp_path / "out").glob("*.gz")), 2)
    assert [r.asDict() for r in back.collect()] == [r.asDict() for r in out.collect()]


def test_regions_file(spark, tmp_path):
    (tmp_path / "r.txt").write_text("Nord\t59\nLot\n\n")
    assert tsv.read_regions(spark, str(tmp_path / "r.txt")) == {"nord": "59", "lot": "lot"}
    tsv.write_regions(spark.createDataFrame([("a", "b")], "name string, code string"), str(tmp_path / "w"))
    assert tsv.read_regions(spark, str(tmp_path / "w")) == {"a": "b"}


def test_postings_and_large_buckets(spark):
    bands = spark.createDataFrame([(-10, 4), (-10, 6), (2, 8), (9, 2), (9, 3), (9, 7)], "key long, rid long")
    store = stores.postings(bands, 2)
    asked = spark.createDataFrame([(k,) for k in (-10, 2, 9, 10)], "key long")
    assert {r["key"]: r["rids"] for r in stores.lookup(store, asked, 2).collect()} == {-10: [4, 6], 2: [8], 9: [], 10: []}


def test_stores_and_models(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("x")
    seen = stores.fingerprint(spark, [str(tmp_path / "in.tsv")])
    path = str(tmp_path / "store")
    manifest = stores.write_store(spark.range(5), path, seen, "train", base_rows=5)
    assert stores.check_store(spark, path, seen, "train") == manifest and manifest["rows"] == 5
    stores.check_pair(manifest, manifest)
    for bad in (lambda: stores.write_store(spark.range(5), path, seen, "train"), lambda: stores.check_store(spark, path, seen, "test"), lambda: stores.check_store(spark, path, [], "train"), lambda: stores.check_store(spark, path + "x", seen, "train"), lambda: stores.check_pair(manifest, manifest | {"inputs": []})):
        with pytest.raises((ValueError, FileExistsError)):
            bad()
    model = {"mean": [0.0], "scale": [1.0], "weights": [0.5, 1.0], "feature_count": 1}
    assert stores.save_model(spark, str(tmp_path / "m.json"), model) == stores.identity(dict(reversed(model.items())))
    assert stores.load_model(spark, str(tmp_path / "m.json"), 1) == model
    with pytest.raises(ValueError):
        stores.load_model(spark, str(tmp_path / "m.json"), 2)
    assert scratch.clear(spark) >= 0
