"""Operator 2: personal data by weak supervision, in DataFrame functions only.

Base spans come from fixed patterns. Wider patterns propose more candidates (numbers that ran together, spelt
out addresses, numbers without a plus, access tokens). Five labelers vote 1, -1 or 0 (none) on every
candidate: its strict format, a checksum or range, a gazetteer (mail domains, issuer digits, dialling codes),
the words before it, and its borders. Expectation-maximisation over the counts of vote patterns estimates
each labeler's reliability by kind and the posterior of each pattern; a logistic span classifier is then
trained on these posteriors. The patterns number at most kinds * 3**5 * LENGTHS, so the table of counts that
reaches the driver is bounded whatever the corpus, and it is taken over all documents.

Offsets count code points, ends are exclusive. Patterns with possessive quantifiers match what the plain ones
match, in linear time and without recursion, so very long texts are safe.

Defined cases: null and empty texts have no spans; rows that repeat a doc_id are each judged; without any
candidate the classifier adds nothing; all other columns pass through ``find`` and ``redact``, whatever their names
(a column named ``pii_spans`` is replaced). Texts are searched once: what the search finds is stored beside the
columns that are kept, and the classifier is fitted on and applied to that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": "+"}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:@|\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}|3[0-9]{3}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?=[\x22'\s,;.]|$)",
}
WIDER_HINT = {"email": r"@|[\(\[\{]at[\)\]\}]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}", "secret": r"[A-Za-z0-9_-]{20}"}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|courriel|correo|reply)[^\n]{0,30}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|ping|adresse)[^\n]{0,30}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta)[^\n]{0,30}$",
    "phone": r"(?i)(?:phone|\btel|call|fax|mobile|telefon)[^\n]{0,30}$",
    "secret": r"(?i)(?:token|secret|api[_ -]?key|password|passwd|bearer|key)[\x20\x22']*[=:][\x20\x22']*$",
}
LABELERS = ("format", "check", "gazetteer", "context", "border")
LENGTHS = 4
CUT = 0.5
STEP = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda's variable, not an expression that each use repeats."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(parts: Column, found: Column) -> Column:
    """Starts (code points from 0) of the matches ``found`` between ``parts``: prefix sums in blocks of STEP,
    so the work is linear in the number of matches."""
    plus = lambda s, x: s + x

    def of(sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STEP).cast("int")), lambda c: F.aggregate(F.slice(sizes, c * STEP + 1, F.lit(STEP)), F.lit(0), plus))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        at = lambda i: F.floor(i / STEP).cast("int")
        return let(starts, lambda begin: F.transform(F.slice(parts, F.lit(1), F.size(found)), lambda p, i: F.element_at(begin, at(i) + 1) + F.aggregate(F.slice(sizes, at(i) * STEP + 1, i % STEP), F.lit(0), plus) + F.char_length(p)))

    return let(F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda a, b: F.char_length(a) + F.char_length(b)), of)


SPAN = "array<struct<start: int, kind: int, end: int, value: string>>"


def matches(text: Column, pattern: str, hint: str, kind: int) -> Column:
    """All matches as (start, kind, end, value); texts without the hint are not searched."""
    span = lambda s, v: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.char_length(v)).alias("end"), v.alias("value"))
    there = F.contains(text, F.lit(hint)) if hint in "@+" else text.rlike(hint)
    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda parts: F.zip_with(positions(parts, found), found, span))).otherwise(F.array().cast(SPAN)))
    return F.when(there, spans).otherwise(F.array().cast(SPAN))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn: every second digit from the right counts double, less 9 over 9."""
    n = F.char_length(number)
    values = F.transform(F.split(number, ""), lambda c, i: F.when((n - i) % 2 == 1, F.expr("0") + F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0


OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    if kind == "card":
        d = digits(v)
        return F.when(F.char_length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits(v)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Matches of the base patterns that are valid, by start and then kind."""
    good = lambda k: lambda x: valid(k, x["value"])
    return F.array_sort(F.concat(*[F.filter(matches(text, BASE[k], HINT[k], i), good(k)) for i, k in enumerate(KINDS[:4])]))


def wider_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[matches(text, WIDER[k], WIDER_HINT[k], i) for i, k in enumerate(KINDS)]))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def by_kind(kind: Column, of: dict) -> Column:
    out = None
    for i, k in enumerate(KINDS):
        out = F.when(kind == i, of[k]) if out is None else out.when(kind == i, of[k])
    return out


def votes(text: Column, x: Column, strict: Column) -> Column:
    """The labelers' votes on one candidate, and its length class."""
    v, d = x["value"], digits(x["value"])
    after = F.substring(text, x["end"] + 1, F.lit(1))
    before = F.substring(text, F.greatest(F.lit(1), x["start"] - 47), F.least(F.lit(48), x["start"]))
    none = F.lit(False)
    check = by_kind(x["kind"], {
        "email": vote(v.rlike(r"\.[A-Za-z]{2,12}$|dot[\)\]\}]\s?[A-Za-z]{2,12}$"), v.rlike(r"[0-9-]$")),
        "ip": vote(v.contains(":") | valid("ip", v), ~valid("ip", v)),
        "card": vote(luhn(d), ~luhn(d)),
        "phone": vote(F.char_length(d).between(10, 13), ~F.char_length(d).between(7, 15)),
        "secret": vote(v.rlike("[0-9]") & v.rlike("[A-Za-z]"), ~v.rlike("[0-9]")),
    })
    gazetteer = by_kind(x["kind"], {
        "email": vote(v.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"), none),
        "ip": vote(v.rlike(r"^(?:10|172|192)\."), v.rlike(r"^0\.|^255\.255\.")),
        "card": vote(d.rlike("^[3-6]"), ~d.rlike("^[2-6]")),
        "phone": vote(v.rlike(r"^\+(?:1|33|34|39|44|49)\b|\b555\b"), d.rlike("^0000|^1111111")),
        "secret": vote(v.rlike(r"^(?:[0-9a-f]{32,64}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk[-_][A-Za-z0-9_-]{16,})$"), v.rlike(r"^[a-z-]+$")),
    })
    cue = by_kind(x["kind"], {k: vote(before.rlike(c), F.lit(k == "secret")) for k, c in CUES.items()})
    border = vote(~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]"), before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]"))
    length = F.least(F.lit(LENGTHS - 1), F.floor(F.char_length(v) / 12).cast("int"))
    return F.struct(vote(strict, none).alias("format"), check.alias("check"), gazetteer.alias("gazetteer"), cue.alias("context"), border.alias("border"), length.alias("length"))


def candidates(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, base, more): the columns ``keep`` (all by default) as one struct, so that no name can clash, the base
    spans, and the other candidates that overlap no base span, with votes."""
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row")
    t = F.col("t")
    found = df.select(row, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).select("row", "t", base_spans(t).alias("base0"), wider_spans(t).alias("more0"))
    clear = F.filter("more0", lambda x: ~F.exists("base0", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    voted = lambda xs, base: F.transform(xs, lambda x: F.struct(x["start"], x["kind"], x["end"], votes(t, x, F.lit(base)).alias("votes")))
    return found.select("row", voted(F.col("base0"), True).alias("base"), voted(clear, False).alias("more"))


def expectation_maximisation(counts: list[tuple], rounds: int = 60) -> dict[tuple, float]:
    """Posterior of each (kind, votes) pattern. Each labeler has, by kind and class, a distribution over its
    three votes (add-one smoothed); the prior is by kind. Abstentions carry no evidence."""
    post = {row[0]: 1 / (1 + math.exp(-1.5 * sum(row[0][1]))) for row in counts}
    for _ in range(rounds):
        prior: dict = {}
        seen: dict = {}
        for key, n in counts:
            kind, vs = key
            for c, w in ((1, post[key] * n), (0, (1 - post[key]) * n)):
                prior[kind, c] = prior.get((kind, c), 1.0) + w
                for j, v in enumerate(vs):
                    if v:
                        seen[kind, j, c, v] = seen.get((kind, j, c, v), 2.0 if (v > 0) == (c == 1) else 1.0) + w
        like = lambda kind, j, c, v: seen.get((kind, j, c, v), 2.0 if (v > 0) == (c == 1) else 1.0) / sum(seen.get((kind, j, c, u), 2.0 if (u > 0) == (c == 1) else 1.0) for u in (1, -1))  # noqa: E731, B023
        new = {}
        for key, _n in counts:
            kind, vs = key
            z = math.log(prior[kind, 1]) - math.log(prior[kind, 0])
            z += sum(math.log(like(kind, j, 1, v)) - math.log(like(kind, j, 0, v)) for j, v in enumerate(vs) if v)
            new[key] = 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))
        moved = max((abs(new[k] - post[k]) for k in new), default=0)
        post = new
        if moved < 1e-6:
            break
    return post


def features(kind: int, vs: tuple, length: int) -> dict[str, float]:
    out = {"bias": 1.0, f"kind{kind}": 1.0, f"length{length}": 1.0}
    for name, v in zip(LABELERS[1:], vs[1:], strict=True):  # the format vote names the base spans, which stay anyway
        if v:
            out[f"{name}{v}"] = 1.0
            out[f"{name}{v}kind{kind}"] = 1.0
    return out


def train_classifier(rows: list[tuple], rounds: int = 400, rate: float = 0.5, l2: float = 1e-3) -> dict[str, float]:
    """Logistic regression on soft labels, over weighted rows (features, posterior, count)."""
    w: dict[str, float] = {}
    speed: dict[str, float] = {}
    total = sum(math.log1p(n) for _, _, n in rows) or 1.0
    for _ in range(rounds):
        g: dict[str, float] = {}
        for f, p, n in rows:
            z = sum(w.get(k, 0.0) for k in f)
            d = (p - 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))) * math.log1p(n) / total
            for k in f:
                g[k] = g.get(k, 0.0) + d
        for k, d in g.items():
            d -= l2 * w.get(k, 0.0)
            speed[k] = speed.get(k, 1e-8) + d * d
            w[k] = w.get(k, 0.0) + rate * d / math.sqrt(speed[k])
    return w


def fit(df: DataFrame) -> dict[str, float]:
    """The span classifier's weights, from all candidates of a frame made by ``candidates``."""
    each = df.select(F.explode(F.concat("base", "more")).alias("x")).groupBy("x.kind", *[f"x.votes.{n}" for n in LABELERS], "x.votes.length").count()
    rows = [((r["kind"], tuple(r[n] for n in LABELERS)), r["length"], r["count"]) for r in each.collect()]
    merged: dict = {}
    for key, _, n in rows:
        merged[key] = merged.get(key, 0) + n
    post = expectation_maximisation(sorted(merged.items()))
    return train_classifier([(features(k[0], k[1], length), post[k], n) for k, length, n in sorted(rows)])


def probability(x: Column, weights: dict[str, float]) -> Column:
    """The classifier as a column over a candidate."""
    names = {"length": x["votes"]["length"], "kind": x["kind"], **{n: x["votes"][n] for n in LABELERS[1:]}}
    z = F.lit(weights.get("bias", -35.0))
    for i in range(len(KINDS)):
        own = F.lit(weights.get(f"kind{i}", 0.0))
        for n in LABELERS[1:]:
            for v in (1, -1):
                own += F.when(names[n] == v, weights.get(f"{n}{v}", 0.0) + weights.get(f"{n}{v}kind{i}", 0.0)).otherwise(0.0)
        z += F.when(names["kind"] == i, own).otherwise(0.0)
    for i in range(LENGTHS):
        z += F.when(names["length"] == i, weights.get(f"length{i}", 0.0)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find(df: DataFrame, text: str = "text", weights: dict[str, float] | None = None, cut: float = CUT, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``pii_spans``: (start, kind, end, base) of all spans by start and
    then kind. To fit the classifier, the candidates of the one search are stored with the kept columns."""
    given = candidates(df, text, keep)
    if weights is None:
        given = stored(given, "pii-candidates")
        weights = fit(given)
    plain = lambda x, base: F.struct(x["start"], x["kind"], x["end"], F.lit(base).alias("base"))
    # A candidate that fails its checksum or range is never added, however little data the weights are from.
    kept = F.filter("more", lambda x: (x["votes"]["check"] >= 0) & (probability(x, weights) >= cut))
    # Of candidates that overlap, the one that starts first stays, the longer one of a tie.
    ranked = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("a"), (-x["end"]).alias("b"), plain(x, False).alias("x"))))
    none = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<start: int, kind: int, end: int, base: boolean>>").alias("out"))
    added = F.aggregate(ranked, none, lambda s, y: F.when(y["a"] >= s["end"], F.struct((-y["b"]).alias("end"), F.concat(s["out"], F.array(y["x"])).alias("out"))).otherwise(s), lambda s: s["out"])
    spans = F.array_sort(F.concat(F.transform("base", lambda x: plain(x, True)), added)).alias("pii_spans")
    return given.select(*[F.col(f"row.`{c}`") for c in (df.columns if keep is None else keep) if c != "pii_spans"], spans)


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace what ``pii_spans`` cover by ``[KIND]``; overlapping spans become one, named by the first."""
    t, tags = F.col(f"`{text}`").cast("string"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    run = "array<struct<start: int, end: int, kind: int>>"
    top = lambda s: F.get(s, F.size(s) - 1)
    span = lambda a, b, k: F.array(F.struct(a.alias("start"), b.alias("end"), k.alias("kind")))
    longer = lambda s, x: F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), span(top(s)["start"], F.greatest(top(s)["end"], x["end"]), top(s)["kind"]))
    merged = F.aggregate("pii_spans", F.array().cast(run), lambda s, x: F.when(F.coalesce(top(s)["end"], F.lit(-1)) > x["start"], longer(s, x)).otherwise(F.concat(s, span(x["start"], x["end"], x["kind"]))))

    def masked(m: Column) -> Column:
        before = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
        pieces = F.transform(m, lambda x, i: F.concat(F.substring(t, before(i) + 1, x["start"] - before(i)), F.element_at(tags, x["kind"] + 1)))
        return F.when(F.size(m) > 0, F.concat(F.array_join(pieces, ""), F.substring(t, top(m)["end"] + 1, F.char_length(t)))).otherwise(t)

    return df.withColumn(text, let(merged, masked))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("pii_spans", lambda x: x["base"])
    of = lambda i: lambda x: x["base"] & (x["kind"] == i)
    counts = [F.size(F.filter("pii_spans", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the personal data in their texts is replaced, and n_chars (if there) follows the text."""
    found = redact(find(docs))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
