"""Text functions on literal rows, similarities on known values, and the tab-separated sources."""

import pytest

from reclink.functions.dialect import SPARK
from reclink.operators import similarity
from reclink.sources import tsv


def of(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").selectExpr(f"{expression} AS y").first()["y"]


@pytest.mark.parametrize(("given", "want"), [("  Orelee's -- Café ", "orelees cafe"), ("PAYNE-ENRTPRMISES & Co", "payne enrtprmises and co"), ("45th 0684 AF-007", "45 684 af 7"), ("", ""), ("नमस्ते। x", "नमस्ते x")])
def test_clean(spark, given, want):
    assert of(spark, SPARK.clean("x"), given) == want


@pytest.mark.parametrize(("given", "want"), [("praaivet", "prvt"), ("private", "prvt"), ("iisat east", "ast ast")])
def test_skeleton(spark, given, want):
    assert of(spark, SPARK.skeleton("x"), given) == want


def test_legal_and_core(spark):
    name = of(spark, SPARK.legal(SPARK.clean("x")), "Acme Private Limited")
    assert name == "acme pvtltd"
    assert of(spark, SPARK.core("x"), name) == "acme"
    assert of(spark, SPARK.core("x"), "ltd co") == "ltd co"


def test_country(spark):
    assert [of(spark, SPARK.country("x"), v) for v in ("U.S.A.", "République Française", " Peru ")] == ["US", "France", "Peru"]


def test_similarities():
    assert similarity.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro_winkler_of("", "a") == 0.0
    assert similarity.indel_ratio_of("abcd", "acbd") == pytest.approx(75.0)
    assert similarity.token_set_ratio_of("a b", "b a c") == 100.0


def test_tsv(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\taddress\tcountry\nS1-1\tA "quoted"\t\tUS\nS1-2\tshort\n')
    path = str(tmp_path / "s.tsv")
    assert [tuple(r) for r in tsv.read_table(spark, path).collect()] == [("S1-1", 'A "quoted"', "", "US")]
    assert tsv.malformed(spark, path).count() == 1
    (tmp_path / "t.tsv").write_text("﻿source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n", encoding="utf-8")
    lists = tsv.read_lists(spark, str(tmp_path / "t.tsv"))
    assert sorted(tuple(r) for r in lists.collect()) == [("S1-1", ["S2-1", "S3-1"]), ("S1-2", [])]
    tsv.write_lists(lists, str(tmp_path / "out"), "source1_entity_id", "matched_entity_ids")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["S1-1\tS2-1,S3-1", "S1-2\t"]
