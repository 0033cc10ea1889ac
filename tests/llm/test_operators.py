"""The training-data operators on small fixtures with hard rows, against brute force in plain Python."""

import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reclink.llm import common, decontaminate, html_text, near_dedup, pieces, pii, quality, substring_dedup, topk, toxicity, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Straße", "naïve", "日本", "😀x"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    for i in range(0, 60, 3):
        t = base[i].split()
        if len(t) > 20:
            t[rng.randrange(len(t))] = "changed"
        base.append(" ".join(t))
    base += [base[0]] * 7 + ["", " \t\n", "a", "a b", None, None, "x " * 400, "x" * 3000, "ab " * 50 + base[5], base[7] + "\x0b" + base[8] + "  "]
    return [(i, t) for i, t in enumerate(base)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in corpus()]
    return spark.createDataFrame([*rows, (None, "no id " * 30, None, None, None)], SCHEMA).repartition(5)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_word_hashes_agree_with_split():
    texts = [t for _, t in corpus()]
    for keep, pattern, lower in ((common.SPACED, r"[^\x20\x09-\x0D]+", False), (common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        w = common.Words(*common.text_bytes(pa.array(texts)), keep, lower)
        flat = [x for t in texts for x in re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or "")]
        assert len(flat) == len(w.hash) and len(set(flat)) == len(set(w.hash.tolist()))


def test_near_dedup(docs):
    sets = {}
    for i, t in corpus():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}
    assert near_dedup.miss_probability(0.85) < 1e-5


def test_near_dedup_across_blocks(spark, docs, monkeypatch):
    want = sorted(map(tuple, near_dedup.near_duplicates(docs.where("doc_id is not null")).collect()))
    monkeypatch.setattr(near_dedup, "MEMBERS", 2)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs.where("doc_id is not null"), rounds=0).collect())) == want


def test_near_dedup_goes_on_when_a_centre_is_drawn_twice(spark):
    """One posting list of three sets: the two that link are not its centre, which both star rounds draw."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(base + ["more"]), *(" ".join(base[5 * k : 5 * k + 60] + [f"{k}v{i}" for i in range(10)]) for k in range(9))]
    sig = {r["doc_id"]: r["sig"] for r in near_dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 1, 3).collect()}
    assert sig[0] == sig[1]
    a = next(k for k in range(2, 11) if sig[k] == sig[0])
    ids = spark.range(1, 60).withColumn("h", F.xxhash64(F.xxhash64(F.lit(0), F.lit(sig[0][0]).cast("long")), "id", F.lit(1)))
    h = {r["id"]: r["h"] for r in ids.collect()}
    centre = min(range(1, 30), key=h.get)
    b, c = [i for i in range(30, 60) if h[i] > h[centre]][:2]
    docs = spark.createDataFrame([(centre, texts[a]), (b, texts[0]), (c, texts[1])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, coords=1, matches=1).collect()}
    assert got == {centre: centre, b: b, c: b}


def test_near_dedup_stage_takes_five_words_and_80_percent(spark):
    """A copy with a sixth more text goes (5-word similarity 0.82); one with a word in 40 changed stays (0.78 by five words, 0.86 by three)."""
    w = [[f"{k}w{i}" for i in range(400)] for k in range(3)]
    changed = [x if i % 40 != 20 else "changed" + x for i, x in enumerate(w[1])]
    rows = [(1, " ".join(w[0][:340])), (2, " ".join(w[0] + [f"more{i}" for i in range(10)])), (3, " ".join(w[1])), (4, " ".join(changed)), (5, " ".join(w[2])), (6, "a b"), (7, "A  b"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup_stage(spark, docs, SF).collect()) == [1, 3, 4, 5, 6, 8]
    assert near_dedup.miss_probability(0.8, near_dedup.COORDS, near_dedup.STAGE["matches"]) < 1e-5


def test_substring_dedup(docs):
    seen, cover = set(), {}
    for i, t in corpus():
        w = words(t)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                cover.setdefault(i, set()).update(range(k, k + 20))
            seen.add(g)
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect()}
    want = {i: (len(c), " ".join(x for k, x in enumerate(words(dict(corpus())[i])) if k not in c)) for i, c in cover.items()}
    assert got == want


def test_substring_dedup_of_repeated_ids(spark, monkeypatch):
    """Each row is a document of its own; rows of one doc_id are not earlier than one another. Frequent names (here
    all that occur twice) are judged the other way with equal results."""
    rng = random.Random(3)
    w = [f"t{i}" for i in range(200)]
    passage = " ".join(w[:45])
    rows = [(7, " ".join(w[100:130])), (7, " ".join(w[100:140])), (7, " ".join(w[100:140])), (3, " ".join(w[120:170])), (9, "x " + passage + " y " + passage), (9, passage), (8, passage + " z"), (None, passage)]
    rows += [(100 + i, " ".join(rng.choices(w, k=5)) + " " + passage + f" end{i}") for i in range(60)]
    want = []
    grams = lambda t: [tuple(words(t)[k : k + 20]) for k in range(len(words(t)) - 19)]
    least = {}
    for i, t in rows:
        for g in grams(t) if i is not None else ():
            least[g] = min(least.get(g, i), i)
    for i, t in rows:
        seen, cover = set(), set()
        for k, g in enumerate(grams(t) if i is not None else ()):
            if least[g] < i or g in seen:
                cover.update(range(k, k + 20))
            seen.add(g)
        if cover:
            want.append((i, len(cover), " ".join(x for k, x in enumerate(words(t)) if k not in cover)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for heavy in (common.HEAVY, 1 << 40):
        monkeypatch.setattr(common, "HEAVY", heavy)
        assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == sorted(want)


def test_decontamination(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(words(corpus()[1][1])[3:20])), (2, "W1"), (3, None), (10, "ab ab AB"), (12, "id no ID no id no"), (None, "w1"), (11, " ".join(words(corpus()[4][1])[:12]))], "item_id long, text string")
    index = decontaminate.build_index(docs)
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for i, t in [*corpus(), (None, "no id " * 30)]:  # a row without a doc_id is judged as any other
        w, hit, items = tok(t), set(), set()
        for r in bench.where("item_id is not null").collect():
            b = tok(r["text"])
            for g in [b[k : k + 10] for k in range(max(1, len(b) - 9))] if b else []:
                for k in range(len(w) - len(g) + 1):
                    if w[k : k + len(g)] == g:
                        hit.update(range(k, k + len(g)))
                        items.add(str(r["item_id"]))
        want[i] = (len(w), len(hit), sorted(items))
    for block, piece in ((100_000, 2_000_000), (5, 2_000_000), (40, 3)):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.search(index, bench).collect()} == want
    near = {tuple(r) for r in decontaminate.proximity(index, "w1 w2", 4).collect()}
    assert near == {(i, k) for i, t in corpus() for w in [tok(t)] for k in range(len(w)) if w[k] in ("w1", "w2") and {"w1", "w2"} <= set(w[k : k + 4])}


def test_decontamination_of_repeated_rows_in_blocks(spark, monkeypatch):
    """Rows that repeat a doc_id are each judged, whatever the number of blocks."""
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w)), (1, " ".join(w[:15])), (1, " ".join(w)), (2, "x y"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, " ".join(w[:12])), (2, " ".join(w[5:16])), (3, " ".join(w[25:36])), (4, " ".join(w[8:20]))], "item_id long, text string")
    index = decontaminate.build_index(docs)
    want = [(1, 15, 15, ["1", "2"]), (1, 40, 31, ["1", "2", "3", "4"]), (1, 40, 31, ["1", "2", "3", "4"]), (2, 0, 0, []), (2, 2, 0, [])]
    for block in (100_000, 40, 5):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.search(index, bench).collect()) == want


def test_pieces_are_lossless_and_repeatable(spark, docs):
    vocab = pieces.Vocabulary.load()
    odd = spark.createDataFrame([(900, " a  b "), (901, "▁x\x00\n\t"), (902, "🤖" * 5)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    a = pieces.encode(rows, vocab, seed=3)
    back = pieces.decode(a.withColumnRenamed("text", "was"), vocab)
    assert all(r["was"] == r["text"] and (r["lossless"] or r["was"] is None) for r in back.collect())
    one = sorted((tuple(r["piece_ids"] or ()), r["doc_id"] or -1) for r in a.collect())
    assert one == sorted((tuple(r["piece_ids"] or ()), r["doc_id"] or -1) for r in pieces.encode(rows.repartition(2), vocab, seed=3).collect())
    assert one != sorted((tuple(r["piece_ids"] or ()), r["doc_id"] or -1) for r in pieces.encode(rows, vocab, seed=4).collect())


def test_pieces_follow_the_lattice_distribution():
    vocab = pieces.Vocabulary([b" a", b"b", b" ", b"a", b"ab"], np.log([0.3, 0.2, 0.2, 0.1, 0.2]), np.arange(5, 261) % 5)
    n = 4000
    data, off = common.text_bytes(pa.array(["ab"] * n))
    ids, begin = pieces.sample(vocab, data, off, np.arange(n).astype(np.uint64), 0, 1.0)
    paths = {(0, 1): 0.3 * 0.2, (2, 3, 1): 0.2 * 0.1 * 0.2, (2, 4): 0.2 * 0.2}
    got = [tuple(ids[begin[i] : begin[i + 1]].tolist()) for i in range(n)]
    for path, p in paths.items():
        assert abs(got.count(path) / n - p / sum(paths.values())) < 0.03


def test_pii(spark):
    texts = [None, "", "mail a.b@c.example.com and 10.0.0.255, 300.1.1.1", "+1 (826) 555-4081 190.137.223.204", "card 4111 1111 1111 1111 or 4111111111111112", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "é a@b.c_d@e.f " * 3, "1 " * 2000, "a" * 5000 + "@", "a." * 4000, "mail x@y.zz " * 3000 + "é 10.1.2.3 " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}

    def good(kind, v):
        d = [int(c) for c in v if c.isdigit()]
        luhn = sum(c if k % 2 == 0 else 2 * c - 9 * (c > 4) for k, c in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    found = {r["doc_id"]: r for r in pii.redact(pii.find(df)).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(base.items()) for m in re.finditer(p, t or "") if good(kind, m[0]))
        assert [(s["start"], s["kind"], s["end"]) for s in found[i]["pii_spans"] if s["base"]] == want
    assert found[2]["text"] == "mail [EMAIL] and [IP], 300.1.1.1" and found[0]["text"] is None and found[9]["text"] == texts[9]


def test_toxicity_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    e, head, a = rng.normal(size=7), np.array([1, 0, 0, 0, 1, 0, 0], bool), np.exp(rng.normal(size=(2, 2)))
    r, b, _ = toxicity.forward_backward(e, head, a)
    got = r * b / (1 + r * b)
    want = np.zeros(7)
    for lo, hi in ((0, 4), (4, 7)):
        total = 0.0
        for y in np.ndindex(*[2] * (hi - lo)):
            p = np.exp(sum(e[lo + k] * v for k, v in enumerate(y))) * np.prod([a[y[k], y[k + 1]] for k in range(hi - lo - 1)])
            total += p
            want[lo:hi] += p * np.array(y)
        want[lo:hi] /= total
    assert np.allclose(got, want)


def test_toxicity_and_quality_learn(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [f"word{rng.randrange(50)}" for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = w[0] = "vileness"
        rows.append((i, " ".join(w) + ("!! $$$ " * 20 if i % 5 == 0 else "")))
        labels.append((i, int(i % 5 != 0), int(bad)))
    rows += [(400, None), (401, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, toxicity.remainder(3) != 1)
    got = {r["doc_id"]: r for r in toxicity.tag(docs, model).collect()}
    score = lambda bad: [got[i]["toxic_score"] for i in range(400) if (i % 4 == 0) == bad]
    assert min(score(True)) > max(score(False)) and got[400]["toxic_score"] < 0.7
    span = got[0]["toxic_spans"][0]
    assert rows[0][1][span["start"] : span["end"]].startswith("vileness")
    x = quality.measured(docs)
    m = quality.train(x, labels, toxicity.remainder(5) != 0)
    s = {r["doc_id"]: r["score"] for r in quality.scored(x, m).collect()}
    assert len(s) == 402 and all((s[i] >= 0.3) == (i % 5 != 0) for i in range(400))
    none = labels.where("false")
    assert {r["toxic_score"] for r in toxicity.tag(docs, toxicity.train(docs, none, F.lit(True))).collect()} == {0.0}
    assert len({r["score"] for r in quality.scored(x, quality.train(x, none, F.lit(True))).collect()}) == 1


def test_quality_equals_one_matrix(spark):
    """Features, ridge weights, pools and scores against plain NumPy over all rows at once; statistics against Python."""
    rng = random.Random(9)
    words_ = ["good", "text", "is", "fine", "$$$", "BUY", "now!", "é7"]
    rows = [(i, "\n".join(" ".join(rng.choice(words_[: 4 + 4 * (i % 3 == 0)]) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 4)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    x = quality.measured(docs)
    stats = {r["doc_id"]: np.array(r["x"]) for r in x.collect()}
    t = dict(rows)[3]
    w = t.split()
    assert stats[3][0] == pytest.approx(np.log1p(len(t.encode()))) and stats[3][1] == pytest.approx(np.log1p(len(w)))
    assert stats[3][10] == pytest.approx(len(set(w)) / len(w)) and stats[3][11] == pytest.approx(max(w.count(v) for v in w) / len(w))
    assert stats[3][13] == pytest.approx(len(set(t.split("\n"))) / len(t.split("\n")))
    model = quality.train(x, labels, F.lit(True))
    fold = {r["doc_id"]: r["f"] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("f")).collect()}
    every = np.array([stats[i] for i in range(300)])
    assert np.allclose(model.mean, every.mean(axis=0)) and np.allclose(model.scale, np.maximum(every.std(axis=0), 1e-3))
    fit = [i for i in range(300) if fold[i] != 0]
    z = np.hstack([np.ones((len(fit), 1)), np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((every[fit] - model.mean) / model.scale, -8, 8) @ model.w + model.b)])
    y = np.array([i % 3 != 0 for i in fit], float)
    ridge = quality.RIDGE * len(fit) * np.diag([0.0] + [1.0] * quality.FEATURES) + 1e-9 * np.eye(quality.FEATURES + 1)
    assert np.allclose(model.beta, np.linalg.solve(z.T @ z + ridge, z.T @ y), atol=1e-6)
    # The kernel: inner products of the features are near exp(-gamma * squared distance).
    u = np.random.default_rng(1).normal(size=(40, quality.STATS)) * 0.3 * model.scale + model.mean
    f = model.features(u)[:, 1:]
    v = (u - model.mean) / model.scale
    assert np.abs(f @ f.T - np.exp(-quality.GAMMA * ((v[:, None] - v[None]) ** 2).sum(axis=2))).max() < 0.35


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(2)
    score, y = np.arange(12.0), rng.integers(0, 2, 12).astype(float)
    s, v = quality.isotonic(score, y)
    assert (np.diff(s) > 0).all() and (np.diff(v) > -1e-12).all() or len(s) == 1
    best = [max(min(y[a : b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]  # minimax form
    assert len(set(np.round(best, 9))) == len(s)


def test_expectation_maximisation_finds_the_planted_reliabilities():
    """Votes drawn with known reliabilities: the posteriors tell true from false candidates, better than the majority."""
    rng = random.Random(4)
    accuracy, counts, truth = (0.95, 0.9, 0.6, 0.55, 0.7), {}, {}
    for _ in range(6000):
        real = rng.random() < 0.4
        vs = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == real else -1) for a in accuracy)
        counts[0, vs] = counts.get((0, vs), 0) + 1
        truth[vs] = truth.get(vs, 0) + (1 if real else -1)
    post = pii.expectation_maximisation(sorted(counts.items()))
    right = lambda rule: sum(n for (_, vs), n in counts.items() if rule(vs) == (truth[vs] > 0))
    assert right(lambda vs: post[0, vs] > 0.5) > right(lambda vs: sum(vs) > 0) and right(lambda vs: post[0, vs] > 0.5) > 0.9 * 6000
    # One step by hand: the likelihoods of one round are those of weighted counts, so equal patterns have equal posteriors.
    weights = pii.train_classifier([(pii.features(0, vs, 0), post[0, vs], n) for (_, vs), n in sorted(counts.items())])
    assert weights["check1"] > 0 > weights["check-1"] and weights["check1"] > abs(weights.get("gazetteer1", 0.0))


def test_toxic_gradient_is_observed_less_expected():
    """The chain's fit raises the likelihood that enumeration gives to the labels."""
    data, off = common.text_bytes(pa.array(["bad word here. fine words here", "bad thing. fine thing", "fine here"] * 8))
    c = toxicity.Chains(data, off)
    words_ = [data[a:b].tobytes().decode() for a, b in zip(c.w.start, c.w.end, strict=True)]
    y = np.array([x.lower() == "bad" for x in words_])
    w, t = toxicity.fit_chain(c, y, 100, epochs=30)
    p = toxicity.Model(w, t, None).marginals(c)
    assert p[y].min() > 0.6 and p[~y].max() < 0.4


HARD = SCHEMA + ", row string, salt int, name string, hit int, c long, key string, toxic_score double, pii_spans string, `a.b` int"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like what the operators make."""
    more = ("r", 1, "n", 2, 3, "k", 0.5, "s", 4)
    long = "long words " * 30_000
    rows = [(1, "Some plain words, mail a.b@c.example.com now.", "en", "s", 45, *more)] * 3
    rows += [(2, None, None, None, None, *[None] * 9), (None, "no id " * 30, "en", None, 180, *more), (None, None, None, None, None, *[None] * 9), (3, "", "de", "s", 0, *more), (4, " \t\n", "fr", "s", 3, *more)]
    rows += [(5, long, "en", "s", len(long), *more), (6, long, "en", "t", len(long), *more), (1, "Another text under a repeated id, 10.0.0.1 inside.", "en", "s", 50, *more)]
    return spark.createDataFrame(rows, HARD).repartition(3)


def test_stages_on_hard_rows(spark, hard):
    """Each stage keeps the columns, defines what becomes of every row, and stands empty tables."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, hard, SF)
        assert out.columns == hard.columns and stage(spark, hard.where("false"), SF).count() == 0, name
        kept = sorted((tuple(r) for r in out.collect()), key=repr)
        given = sorted((tuple(r) for r in hard.collect()), key=repr)
        if name == "near_dedup":
            ids = [r[0] for r in kept]
            assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5] and ids.count(None) == 2
        elif name == "pii":
            texts = {r[1] for r in kept}
            assert len(kept) == len(given) and "Some plain words, mail [EMAIL] now." in texts and "Another text under a repeated id, [IP] inside." in texts
            assert all(r[4] == (None if r[1] is None else len(r[1])) for r in kept if r[1] is not None)
        else:
            assert kept == given, name
    out = corpus_pipeline.STAGES[-1][1](spark, hard, SF)
    assert out.columns == [*hard.columns, "piece_ids", "lossless"] and out.where("not lossless").count() == 0 and out.count() == hard.count()


def test_decontamination_stage_judges_each_text(spark, tmp_path):
    """Rows without an id and rows of one id are judged by their own texts."""
    leak = " ".join(f"q{i}" for i in range(12))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "x " + leak), (1, "clean"), (None, leak), (None, "also clean"), (2, None)], "doc_id long, text string")
    got = decontaminate.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "clean"), (None, "also clean"), (2, None)], key=repr)


def test_operators_on_hard_rows(spark, hard):
    """Every operator returns its row for each row (or leaves out what its docstring says), also of an empty table."""
    n, none = hard.count(), hard.where("false")
    near = near_dedup.near_duplicates(hard)
    assert near.count() == n and near_dedup.near_duplicates(none).count() == 0
    by_id = {r["doc_id"]: r["component_id"] for r in near.collect()}
    assert by_id[5] == by_id[6] == 5 and by_id[2] == 2
    index = decontaminate.build_index(hard)
    bench = spark.createDataFrame([(1, "long words long words long words long words long words long words")], "item_id long, text string")
    assert decontaminate.search(index, bench).count() == n and decontaminate.search(decontaminate.build_index(none), bench).count() == 0
    assert decontaminate.search(index, bench.where("false")).where("n_hit > 0").count() == 0
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.search(index, bench).collect()}[6] == 60_000
    assert {r["doc_id"] for r in substring_dedup.remove_repeats(hard).collect()} == {5, 6} and substring_dedup.remove_repeats(none).count() == 0
    assert pii.find(hard).count() == n and pii.find(none).count() == 0
    x = quality.measured(hard)
    assert x.count() == n and quality.measured(none).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert quality.scored(x, quality.train(x, labels, F.lit(True))).count() == n
    assert toxicity.tag(hard, toxicity.train(hard, labels, F.lit(True))).count() == n
    assert pieces.encode(hard, pieces.Vocabulary.load()).count() == n
    pages = hard.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "row", "hit", "key")
    assert html_text.extract(pages).count() == n and html_text.extract(pages.where("false")).count() == 0
    clash = pages.withColumn("host", F.lit("h")).withColumn("path", F.lit("p")).withColumn("c", F.lit(1))
    judged = urls.judge(clash, urls.listed_urls(spark))
    assert judged.count() == n and {r["verdict"] for r in judged.collect()} == {"allow"} and urls.judge(clash.where("false"), urls.listed_urls(spark)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, ids string")
    assert topk.top_k(vectors, vectors, 5).count() == 0


def test_listed_urls_decide(spark):
    """The registered list: 159,984 URLs; variants of a listed URL are blocked, near misses are not, and copies are each
    judged."""
    listed = urls.listed_urls(spark)
    assert listed.count() == 159_984 and listed.distinct().count() == 159_984
    given = {"http://casino-win.example.com/en/1?utm_source=feed": "block", "https://m.casino-win.example.com/en/1/#top": "block", "https://www.casino-win.example.com/en/1": "block", "https://casino-win.example.com/en/3": "allow", "https://casino-win.example.com/en/1.html": "allow", "https://x.casino-win.example.com/en/1": "allow", "https://blog.spam-farm.example.org/es/9998": "block", "https://spam-farm.example.org/es/10000": "allow"}
    rows = [(i, u) for i, u in enumerate(given)] + [(100 + i, "https://casino-win.example.com/en/2") for i in range(500)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), listed).collect()}
    assert [got[i] for i in range(len(given))] == list(given.values()) and {got[100 + i] for i in range(500)} == {"block"}


def test_scratch_folders_are_deleted(spark):
    path = common.stored(spark.range(3), "gone").inputFiles()[0]
    import os

    assert os.path.exists(path.removeprefix("file://")) and common.clear_scratch(spark) > 0 and not os.path.exists(path.removeprefix("file://"))


def test_op1_query_equals_its_operator(spark):
    got = {r["doc_id"]: (r["n_pieces"], r["ids"], r["lossless"]) for r in pieces.op1_pieces(spark, SF).collect()}
    docs = common.table(spark, SF, "documents")
    back = {r["doc_id"]: r for r in pieces.encode(docs, pieces.Vocabulary.load(), seed=11).collect()}
    assert len(got) == docs.count() and all(got[i] == (len(r["piece_ids"]), r["piece_ids"], True) for i, r in back.items() if r["text"] is not None)


def test_held_out_accuracy(spark):
    for name, query, label in (("toxic", toxicity.op3_toxicity, "toxic"), ("quality", quality.op7_quality, "quality")):
        p = query(spark, "/root/testdata/sf0.1").where("held_out").join(common.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").toPandas()
        hi, lo = p[p[label] == 1].score.to_numpy(), p[p[label] == 0].score.to_numpy()
        assert ((hi[:, None] > lo[None]).mean() + 0.5 * (hi[:, None] == lo[None]).mean()) > 0.95, name


def test_urls(spark):
    listed = spark.createDataFrame([("http://www.bad.example.com/x/?b=2&a=1#f",), (None,)], "url string")
    given = ["https://bad.example.com/x?a=1&b=2&utm_source=q", "http://ok.example.com/", "HTTP://A.Example.NET/en/1", "http://a.example.net/de", "http://x.org/fr/1?q", "nothing", None, "http://notexample.com/de/1", "http://EXAMPLE.com/de/"]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id long, url string"), listed).collect()}
    assert [got[i]["verdict"] for i in range(9)] == ["block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "block"]
    assert [got[i]["rule"] for i in range(9)] == [None, None, "example.net/en/", "net/", "org/fr/", None, None, None, "example.com/de/"]
    tiny = urls.listed_hits(spark.createDataFrame([(f"k{i}",) for i in range(500)], "key string"), "key", spark.createDataFrame([(f"k{i}",) for i in range(0, 500, 7)], "key string"), log2_blocks=1)
    assert sorted(r["key"] for r in tiny.collect()) == sorted(f"k{i}" for i in range(0, 500, 7))


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(120)] + [(200, None), (201, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v and None not in v and not np.isnan(v).any()}
    want = []
    for a in (i for i in q if i % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a)[:5]
        want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df.where("vec_id % 50 = 0"), df, 5).collect())) == sorted(want)


def test_topk_ties_repeats_and_many_blocks(spark, monkeypatch):
    """Small integers give ties everywhere; rows repeat an id; many query blocks meet many candidate blocks."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, size=rng.integers(0, 5)) / 4]) for i in rng.integers(0, 90, size=150)] + [(None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    q = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None]
    for cells in (10_000, 5):
        monkeypatch.setattr(topk, "CELLS", cells)
        asked = df.where("vec_id % 9 = 0").dropDuplicates(["vec_id"])
        got = {}
        for r in topk.top_k(asked, df, 4).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        own = {r["vec_id"]: [int(np.floor(256 * x)) for x in r["embedding"]] for r in asked.collect()}
        want = {}
        for a, v in own.items():
            best = sorted((-sum(x * y for x, y in zip(v, w)), b) for b, w in q if b != a)[:4]
            want[a] = [(k + 1, b, -s) for k, (s, b) in enumerate(best)]
        assert {a: sorted(x) for a, x in got.items()} == want


def test_html(spark):
    page = """<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>menu</a></nav><div class="cookie-notice">ok?</div><article><h1>T &amp; x</h1>
    <p><b>One<br>two <i>thr</i>ee<p>four</p><aside>side</aside><form>f</form></article><section id="comments"><p>me too</p></section><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page) == "T & x One two three four"
    assert html_text.main_text("<body><p>a&am <p>b<a hre") == "a&am b" and html_text.main_text(None) == "" and html_text.main_text("") == ""
    rows = [(i, "http://h/x", f"<body><div class='q'>Same promo {i}</div><p>Body {html.escape('<' + str(i) + chr(97 + i))}</p></body>") for i in range(20)] + [(99, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got[3] == "Body <3d" and got[99] == "" and len(got) == 21


def test_html_templates_inside_articles(spark):
    """What recurs on most pages of a host goes from articles and main also; what fewer share and whole copies stay."""
    shared = lambda i: "<p>Told by three.</p>" if i < 3 else ""
    rows = [(i, "http://h/x", f"<body><article><h1>News</h1><div class='q'>Read <b>our</b> best stories</div>{shared(i)}<p>Body {i}</p></article></body>") for i in range(20)]
    rows += [(100 + i, "http://m/x", f"<body><main><section>House rules</section><p>Own {i}</p></main><p>Out</p></body>") for i in range(20)]
    rows += [(200 + i, "http://c/x", "<body><article><p>One page, copied.</p></article></body>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert (got[1], got[7], got[105], got[203]) == ("News Told by three. Body 1", "News Body 7", "Own 5", "One page, copied.")


def test_html_templates_equal_counting_by_hand(spark):
    """Site furniture without a telling tag or class, on pages with and without an article, on hosts of several
    sizes and in copies: which subtrees go, and what is left, against plain counting. Without the counts it stays."""
    rng, rows = random.Random(8), []
    for i in range(160):
        host = ("big", "big", "mid", f"small{i % 40}")[i % 4]
        top, end = f"<div class='x{i % 3}'>Top {host} {i % 2} <b>v{i}</b></div>", f"<section><p>All of {host}</p><p>since {1900 + i % 7}</p></section>"
        own = "".join(f"<p>{rng.choice(['Shared by some.', f'Own {i} {k}.'])}</p>" for k in range(rng.randint(1, 4)))
        inner = "<div>Read more of us</div>" if host == "mid" else ""
        body = f"<article><h2>T{i}</h2>{own}{inner}</article>" if i % 5 else f"<h2>T{i}</h2><div>{own}</div>"
        rows.append((i, f"http://{host}/{i}", f"<html><body>{top}{body}{end}</body></html>"))
    rows += [(500 + i, "http://big/c", "<body><div>Copied page</div></body>") for i in range(30)] + [(900, None, None), (901, None, ""), (None, "http://big/n", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    host = lambda u: u.split("/")[2] if u else ""
    held, count, different, pages_of = {}, {}, {}, {}
    for _, u, h in rows:
        pages_of[host(u)] = pages_of.get(host(u), 0) + 1
        for x in html_text.subtrees(h)[0] if h else ():
            count[host(u), x] = count.get((host(u), x), 0) + 1
            different.setdefault((host(u), x), set()).add(h)
    for (k, x), n in count.items():
        if (x & 1 and n >= 8 and 2 * n >= pages_of[k]) or (not x & 1 and len(different[k, x]) >= 5):
            held.setdefault(k, set()).add(x)
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: html_text.main_text(h, held.get(host(u), frozenset())) for i, u, h in rows}
    without = {i: html_text.main_text(h) for i, u, h in rows}
    assert sum(got[i] != without[i] for i in got) > 40 and got[520] == "Copied page" and got[901] == ""
    assert "Read more" not in got[6] and got[20].startswith("T20 ") and "Top" not in got[20] and "All of big" not in got[20]
    assert sum("Shared by some." in t for t in got.values()) > 40


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(none).count() == 0 and decontaminate.search(decontaminate.build_index(none), none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0 and pii.find(none).count() == 0 and pieces.encode(none, pieces.Vocabulary.load()).count() == 0
    assert toxicity.tag(none, toxicity.Model(np.zeros(toxicity.WIDTH), np.ones((2, 2)), None)).count() == 0
    odd = spark.createDataFrame([(1, "some words here", "x", "y", 3, "row", 5.0, 7)], SCHEMA + ", row string, toxic_score double, text2 int")
    assert toxicity.tag(odd, toxicity.Model(np.zeros(toxicity.WIDTH), np.ones((2, 2)), None)).first()["row"] == "row"
    assert pieces.encode(odd, pieces.Vocabulary.load()).first()["lossless"] and pii.find(odd).first()["pii_spans"] == []


def test_pipeline(spark):
    docs = common.table(spark, SF, "documents")
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) <= set(out.columns)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, SF, "labels").collect()}
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()
    clean = [i for i, t in labels.items() if t == 0]
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id")
    found = {r["doc_id"]: r for r in out.collect()}
    masked = pii.redact(pii.find(docs.where(F.col("doc_id").isin(ids)))).select("doc_id", "text")
    assert {r["doc_id"]: r["lossless"] for r in out.collect()} == {i: None if found[i]["text"] is None else True for i in ids}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(out.drop("text"), pieces.Vocabulary.load()).collect()}
    assert back == {i: r["text"] for i, r in found.items()} and sum("[EMAIL]" in (t or "") for t in back.values()) > 0
    assert sum(r["text"] == back[r["doc_id"]] for r in masked.collect()) > 0.95 * len(ids)
    assert {i for i in clean if i in {r["doc_id"] for r in kept.collect()}} - set(ids) <= {r["doc_id"] for r in decontaminate.op4_decontamination(spark, SF).where("contaminated").collect()} | set()


def test_digest_of_items():
    assert decontaminate.digest([10, 2]) == hashlib.sha256(b"10,2").hexdigest()
