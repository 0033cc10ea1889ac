"""Operators on pairs against plain Python on small rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reclink.operators import linkage, scoring, similarity
from reclink.plans import catalogue


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] + 1 if x == y else max(old[j], row[j - 1]))
    return row[-1]


def test_similarities_equal_dynamic_programming():
    rng = random.Random(6)
    texts = ["", "a", "café test"] + ["".join(rng.choice("abcd é") for _ in range(rng.randint(1, 30))) for _ in range(25)]
    for a in texts:
        for b in texts:
            assert similarity.levenshtein_of(a, b) == plain_edit(a, b)
            assert similarity.indel_ratio_of(a, b) == pytest.approx(200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0)
            s, t = sorted((a, b), key=len)
            if s:
                windows = [t[max(i, 0) : i + len(s)] for i in range(1 - len(s), len(t))]
                assert similarity.partial_ratio_of(a, b) == pytest.approx(max(similarity.indel_ratio_of(s, w) for w in windows))


def test_known_ratios():
    assert similarity.token_sort_ratio_of("b a c", "c b a") == 100.0 and similarity.partial_ratio_of("abc", "xxabcxx") == 100.0
    assert similarity.weighted_ratio_of("alpha beta", "beta alpha") == pytest.approx(95.0) and similarity.weighted_ratio_of("", "a") == 0.0
    assert similarity.weighted_ratio_of("alpha", "alpha beta gamma") == pytest.approx(90.0) and similarity.levenshtein_similarity_of("", "a") == 0.0


FIELDS = ("name_sorted", "name_nospace", "name_cons", "name_phon", "addr_norm", "addr_house")


@pytest.fixture(scope="module")
def pairs(spark):
    sides = [("cafe test", "cafetest", "cf tst", "cafe", "12 rue principale 7", "12"), ("test café", "testcafé", "cf", "", "7 rue principale 12", "21"), ("", "", "", "", "", ""), ("cafe tost", "cafetost", "cf tst", "cafe", "12 rue principale 7", "12")]
    rows = [(f"S1-{i}", f"S2-{j}", *a, *b) for i, a in enumerate(sides) for j, b in enumerate(sides)]
    return spark.createDataFrame(rows, ", ".join(["q string", "rid string"] + [f"{p}_{f} string" for p in "qr" for f in FIELDS]))


def test_edit_features(pairs):
    out = linkage.edit_features(pairs)
    assert out.columns[-22:] == [f"f{i}" for i in range(107, 129)]
    fns = (similarity.levenshtein_similarity_of, similarity.jaro_winkler_of, lambda a, b: similarity.indel_ratio_of(a, b) / 100)
    ordered = lambda x: " ".join(sorted(x.split()))
    for r in out.collect():
        sides = [(r[f"q_{f}"], r[f"r_{f}"]) for f in linkage.EDITED] + [(ordered(r["q_addr_norm"]), ordered(r["r_addr_norm"]))]
        want = [fn(a, b) if a and b else 0.0 for a, b in sides for fn in fns]
        want += [fn(a, b) / 100 if a and b else 0.0 for a, b in (sides[0], sides[4]) for fn in (similarity.token_set_ratio_of, similarity.weighted_ratio_of)]
        assert [r[f"f{i}"] for i in range(107, 129)] == pytest.approx(want)


def test_late_features(spark, pairs):
    queries = spark.createDataFrame([("cafe test",), ("cafe one",), ("two",)], "x string")
    idf = {r["token"]: r["idf"] for r in linkage.idf_table(queries, "x").collect()}
    assert idf == pytest.approx({"cafe": math.log(4 / 3) + 1, "test": math.log(2) + 1, "one": math.log(2) + 1, "two": math.log(2) + 1})
    default = linkage.idf_default(3)
    table = (linkage.idf_table(queries, "x"), default)
    out = linkage.late_features(pairs, {"name": table, "address": table})
    weigh = lambda x: {t: idf.get(t, default) for t in x.split()}

    def alike(a, b):
        a, b = weigh(a), weigh(b)
        both = a.keys() & b.keys()
        norm = math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
        return [sum(a[t] ** 2 for t in both) / norm if norm else 0.0, sum(a[t] for t in both) / min(sum(a.values()), sum(b.values())) if a and b else 0.0]

    def soft(a, b):
        a, b = weigh(a), weigh(b)
        if not a or not b:
            return [0.0] * 3
        best = {t: max(similarity.indel_ratio_of(t, u) for u in b) / 100 for t in a}
        return [best[max(a, key=lambda t: (len(t), t))], best[max(a, key=lambda t: (a[t], len(t), t))], sum(a[t] * best[t] for t in a) / sum(a.values())]

    import re

    for r in out.collect():
        x, y = [re.findall("[0-9]+", r[f"{p}_addr_norm"]) for p in "qr"]
        n = [len(r[f"{p}_name_nospace"]) for p in "qr"]
        want = alike(r["q_name_sorted"], r["r_name_sorted"]) + alike(r["q_addr_norm"], r["r_addr_norm"])
        want += [min(n) / 40, max(n) / 40, len(set(r["q_name_sorted"].split())) / 10, len(set(r["r_name_sorted"].split())) / 10, len(r["q_addr_norm"]) / 150, len(r["r_addr_norm"]) / 150]
        want += [len(set(x) - set(y)), len(set(y) - set(x)), len(set(x) & set(y)), float(bool(x) and x == y), float(bool(x) and sorted(x) == sorted(y)), abs(len(x) - len(y))]
        want += [plain_edit(r["q_name_nospace"], r["r_name_nospace"]) / 20, similarity.indel_ratio_of(r["q_addr_house"], r["r_addr_house"]) / 100 if r["q_addr_house"] and r["r_addr_house"] else 0.0]
        want += soft(r["q_name_sorted"], r["r_name_sorted"]) + soft(r["r_name_sorted"], r["q_name_sorted"])
        assert [r[f"f{i}"] for i in range(129, 153)] == pytest.approx(want)


def test_scores_and_matches(spark):
    rows = spark.createDataFrame([("a", "S2-1", 1.0, 0.0), ("a", "S3-1", 0.5, 2.0), ("b", "S2-2", -90.0, 0.0)], "q string, rid string, x double, y double")
    mean, scale = linkage.moments(rows, ["x", "y"])
    assert scale[0] > 40 and linkage.moments(rows.withColumn("x", F.lit(1.0)), ["x"]) == ([1.0], [1.0])
    model = {"mean": [0.5, 0.0], "scale": [0.5, 2.0], "weights": [0.25, 1.0, -2.0]}
    out = linkage.predict_scores(rows, ["x", "y"], model)
    z = {"S2-1": 1.25, "S3-1": -1.75, "S2-2": -35.0}
    assert {r["rid"]: r["score"] for r in out.collect()} == pytest.approx({k: 1 / (1 + math.exp(-v)) for k, v in z.items()})
    with pytest.raises(ValueError):
        linkage.predict_scores(rows, ["x"], model)
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "q string")
    lists = {r["q"]: (r["candidates"], r["matches"]) for r in linkage.matches(out, queries, 0.5).collect()}
    assert lists == {"a": (["S2-1", "S3-1"], ["S2-1"]), "b": (["S2-2"], []), "c": ([], [])}
    assert {r["q"]: r["matches"] for r in linkage.matches(out, queries, 0.0, 0.9).collect()} == {"a": ["S2-1"], "b": ["S2-2"], "c": []}


def test_gate_is_the_largest_that_loses_nothing(spark):
    rows = spark.createDataFrame([(0.0002, 0.1, 0.0), (0.02, 0.9, 0.0), (0.04, 0.2, 1.0), (0.9, 0.9, 1.0)], "gate double, full double, label double")
    gate, trials = linkage.choose_gate(rows, 0.5)
    assert gate == 0.01 and [t["true_pairs_lost"] for t in trials] == [0] * 8 + [1] * 3 and [t["positives_lost"] for t in trials] == [0] * 7 + [1] * 4
    assert linkage.choose_gate(rows.where("gate > 1"), 0.5)[0] == 0.2 and linkage.cascade(rows, gate, lambda x: x).count() == 3


def test_rarity_pool_and_rerank(spark):
    bands = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12)] + [(4, i) for i in range(20, 26)], "key long, rid long")
    asked = spark.createDataFrame([("q", k) for k in (1, 2, 3, 4)], "q string, key long")
    votes = linkage.rarity(asked, bands, 5)
    got = {r["rid"]: (r["votes"], r["rarity"]) for r in votes.collect()}
    assert got == {10: (2, pytest.approx(1 + 2**-0.5)), 11: (1, pytest.approx(2**-0.5)), 12: (1, pytest.approx(1.0))}
    assert sorted(r["rid"] for r in linkage.pool(votes, 1).collect()) == [10]
    more = spark.createDataFrame([("q", 1, 3, 0.1), ("q", 2, 2, 0.2), ("q", 3, 1, 9.0)], "q string, rid long, votes long, rarity double")
    assert sorted(r["rid"] for r in linkage.pool(more, 1).collect()) == [1, 3]
    texts = {10: "alpha", 11: "alphq", 12: "zzz"}
    fields = ("name_sorted", "name_nospace", "name_cons", "addr_norm")
    rows = [("q", rid, v, *["alpha"] * 4, *[texts[rid]] * 4) for rid, v in ((10, 1), (11, 5), (12, 9))]
    pool = spark.createDataFrame(rows, ", ".join(["q string", "rid long", "votes long"] + [f"{p}_{f} string" for p in "qr" for f in fields]))
    for view in ("name", "address", "skeleton"):
        assert [(r["rid"], r["rank"], r["votes"]) for r in linkage.rerank(pool, view, 2).orderBy("rank").collect()] == [(10, 1, 1), (11, 2, 5)]
    assert [r["rid"] for r in linkage.rerank(pool, "name", 3).orderBy("rank").collect()] == [12, 11, 10]


def test_samples_and_splits(spark):
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(100)], "q string")
    one = {r["q"] for r in linkage.sample(ids, 30).collect()}
    assert len(one) == 30 and one == {r["q"] for r in linkage.sample(ids.repartition(7), 30).collect()}
    rest = linkage.sample(ids, 90, exclude=spark.createDataFrame([(q,) for q in one], "q string"))
    assert not one & {r["q"] for r in rest.collect()} and rest.count() == 70
    parts = linkage.split(ids, {"fit": 0.7, "calibrate": 0.15, "audit": 0.15}).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"fit": 70, "calibrate": 15, "audit": 15}
    fixed = linkage.split(ids, {"fit": 80, "calibrate": 12, "audit": 8}).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in fixed} == {"fit": 80, "calibrate": 12, "audit": 8}
    linkage.check_coverage(ids, ids)
    for bad in (ids.limit(99), ids.unionByName(ids.limit(1))):
        with pytest.raises(ValueError):
            linkage.check_coverage(ids, bad)


def test_reports(spark):
    truth = spark.createDataFrame([("a", "S2-1"), ("a", "S3-1"), ("a", "S2-9"), ("b", "S2-2")], "q string, rid string")
    found = spark.createDataFrame([("a", "S2-1"), ("a", "S3-1"), ("a", "S2-5"), ("b", "S2-2"), ("c", "S2-7")], "q string, rid string")
    queries = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "q string")
    r = linkage.recall_report(truth, found, queries, 10)
    assert r["pair_recall"] == 0.75 and r["macro_recall"] == pytest.approx((2 / 3 + 1) / 2) and r["complete"] == 0.5 and r["reduction_ratio"] == 1 - 5 / 40
    assert r["oracle_f05"] == pytest.approx((2.5 / 2.75 + 3) / 4) and (r["singletons"], r["singletons_with_candidates"], r["zero_candidate_queries"], r["p95_candidates"]) == (2, 1, 1, 3)
    slices = {x["slice"]: (x["total"], x["retrieved"]) for x in linkage.recall_slices(truth, found, {"source": F.substring("rid", 1, 2)}).collect()}
    assert slices == {"source:S2": (3, 2), "source:S3": (1, 1)}
    rows = spark.createDataFrame([(True, "x", "x", "1", "1"), (True, "", "", "1", "2"), (False, "x", "y", "1", "1")], "true boolean, q_a string, r_a string, q_b string, r_b string")
    assert {x["key"]: (x["hit_pct"], x["fp_pct"]) for x in linkage.lift(rows, ("a", "b", "a+b")).collect()} == {"a": (50.0, 0.0), "b": (50.0, 100.0), "a+b": (50.0, 0.0)}
    scripts = spark.createDataFrame([("s2", "US", "latin")] + [("s3", "US", "other")] * 30, "source string, country string, name_script string")
    report = {(x["source"], x["country"], x["script"]): (x["n"], x["pct"], x["warning"]) for x in linkage.script_report(scripts).collect()}
    assert report[("s3", None, "other")] == (30, 100.0, True) and report[("s2", "US", "latin")] == (1, 100.0, False)


def test_validators(spark):
    lists = spark.createDataFrame([("S1-1", ["S2-1", "S2-1"]), ("S1-1", []), ("S1-2", ["S1-9", "X-1", "S3-8"]), ("S1-7", ["S2-1"])], "q string, ids array<string>")
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "q string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    got = {r["rule"]: (r["n"], r["examples"]) for r in linkage.validate_lists(lists, required, known).collect()}
    assert got == {"duplicate row": (1, ["S1-1"]), "repeated id": (1, ["S1-1"]), "source 1 id": (1, ["S1-9"]), "other prefix": (1, ["X-1"]), "required missing": (1, ["S1-3"]), "not required": (1, ["S1-7"]), "unknown id": (1, ["S3-8"])}
    assert linkage.validate_lists(lists.where("q = 'none'"), required.limit(0)).count() == 0
    assert [tuple(r) for r in linkage.outside_candidates(lists, lists.where("q <> 'S1-7'")).collect()] == [("S1-7", "S2-1")]


def test_evidence_and_unknown_countries(spark):
    routes = spark.createDataFrame([("q", 1, "name", 1, 8.0), ("q", 1, "exact_name_sorted", 1, None), ("q", 2, "name", 2, 3.0)], "q string, rid long, route string, rank int, score double")
    got = {r["rid"]: r for r in linkage.evidence_of(routes).collect()}
    assert got[1]["fusion"] == pytest.approx(2 / 61) and got[1]["place"] == 1 and got[2]["routes"]["name"]["score"] == 3.0 and linkage.evidence_of(routes, 1).count() == 1
    asked = spark.createDataFrame([("a", "us", 1), ("b", "", 2)], "q string, country string, key long")
    countries = spark.createDataFrame([("us",), ("fr",), ("us",)], "country string")
    assert sorted((r["q"], r["country"]) for r in linkage.voting_keys(asked, countries).collect()) == [("a", "us"), ("b", "fr"), ("b", "us")]
    assert spark.range(1).select(linkage.hex_token(F.lit("Aé"))).first()[0] == "x61c3a9"


def test_threshold_of_the_best_score(spark):
    """Scores .9, .8 (right, wrong) for a query with one more true id, .1 for one that matches nothing: t lies in (.8, .9]."""
    frames = {"q": spark.createDataFrame([("a",), ("b",)], "q string")}
    text = catalogue.threshold_choice(catalogue.SPARK)
    head, tail = text.index("t AS ("), text.index(", nt AS (")
    rows = "t AS (SELECT 'a' AS q, 'x' AS c UNION ALL SELECT 'a', 'missed'), g AS (SELECT 'a' AS q, 'x' AS c, 0.9D AS s UNION ALL SELECT 'a', 'y', 0.8D UNION ALL SELECT 'b', 'z', 0.1D), o AS (SELECT q, q AS slice FROM asked)"
    got = catalogue.over(spark, text[:head] + rows + text[tail:], asked=frames["q"]).first()
    assert got["threshold"] == 0.9 and got["macro_f05"] == pytest.approx((1.25 / 1.5 + 1) / 2, abs=1e-6)


@pytest.mark.parametrize("query", [scoring.trained_lr_score, scoring.trained_tree_score])
def test_trained_scores_tell_pairs_apart(spark, query):
    p = query(spark, "/root/testdata/sf0.1").toPandas()
    audit = p[p.part == "audit"]
    hi, lo = audit[audit.label == 1].score.to_numpy(), audit[audit.label == 0].score.to_numpy()
    assert len(hi) > 20 and len(lo) > 20 and ((hi[:, None] > lo[None]).mean() + 0.5 * (hi[:, None] == lo[None]).mean()) > 0.8
