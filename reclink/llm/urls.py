"""Operator 6: URL filters by a blocked Bloom filter and an exact join, in DataFrame functions only.

The canonical URLs of a list are hashed into a blocked filter: one hash picks a block of ``WORDS`` 64-bit
words, others one bit in each word. The filter has a fixed number of blocks (``2**log2_blocks``; 4 MB at the
default), built with map-side combining, and is broadcast: its size has that bound whatever the list. URLs
whose bits are all set are possible hits; a hash join with the list itself then removes the false positives,
so the result is exact, and a list too large for its filter costs time only.

Rules on host and path come first: a rule fits its host and all subdomains where the path starts with the
rule's path, and the longest rule wins. What no rule decides is blocked if its canonical URL is listed.

Canonical form: scheme, user, port, fragment and tracking parameters dropped, host in lower case without
``www.``, path without its last slash, other parameters sorted.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and is allowed; null
entries of the list are ignored; repeated rows are each judged; an empty list blocks nothing; the html and
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LOG2_BLOCKS, WORDS = 16, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.coalesce(F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.char_length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    rest = F.regexp_replace(after_scheme(url), "(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), ":[0-9]*$", ""), r"^www\.", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[a-z]+|ref|fbclid|gclid)=")))
    return F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def fits(host: Column, path: Column, rule: tuple) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def block_of(key: Column, log2_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(1 << log2_blocks))


def bit(key: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(k + 1)), F.lit(64)).cast("int")


def blocked_filter(listed: DataFrame, log2_blocks: int = LOG2_BLOCKS) -> DataFrame:
    """(block, w0 .. w7) of the blocks that hold anything: 2**log2_blocks rows at most."""
    given = listed.select(block_of(F.col("key"), log2_blocks).alias("block"), *[bit(F.col("key"), k).alias(f"b{k}") for k in range(WORDS)])
    return given.groupBy("block").agg(*[F.expr(f"bit_or(shiftleft(1L, b{k}))").alias(f"w{k}") for k in range(WORDS)])


def listed_hits(rows: DataFrame, key: str, listed: DataFrame, log2_blocks: int = LOG2_BLOCKS) -> DataFrame:
    """The rows whose key is in ``listed`` (column key)."""
    keys = listed.where("key is not null and key <> ''")
    blocks = F.broadcast(blocked_filter(keys, log2_blocks))  # at most 2**log2_blocks rows of 72 bytes
    probed = rows.withColumn("block", block_of(F.col(key), log2_blocks)).join(blocks, "block")
    full = None
    for k in range(WORDS):
        hit = F.getbit(F.col(f"w{k}"), bit(F.col(key), k)) == 1
        full = hit if full is None else full & hit
    return probed.where(full).select(rows.columns).join(keys.select(F.col("key").alias(key)).distinct(), key, "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to the pages (columns of these names are replaced). ``listed``: URLs to
    block (column url). The pages' columns travel as one struct, so no name can clash."""
    u = F.col(f"`{url}`").cast("string")
    new = ("host", "path", "rule", "verdict")
    found = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("key"))
    # Longest first: of two rules that fit one host, the longer name is the more special host.
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0] + r[1])):
        rule = F.when(fits(F.col("host"), F.col("path"), r), F.lit(r[0] + r[1])).otherwise(rule)
        verdict = F.when(fits(F.col("host"), F.col("path"), r), F.lit(r[2])).otherwise(verdict)
    found = found.select("row", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.when(F.col("host") != "", F.col("key")).alias("key"))
    asked = found.where("rule is null and key is not null").groupBy("key").agg(F.count("*").alias("c"))
    hits = listed_hits(asked, "key", listed.select(canonical(F.col("url").cast("string")).alias("key"))).withColumn("hit", F.lit("block"))
    # A URL can be that of a third of all pages: its pages are dealt out.
    marked = salted_join(found, hits, ["key"], max(1, pages.count()), ["row"], "left")
    by_list = F.when(F.col("rule").isNull(), F.col("hit"))
    return marked.select(*[F.col(f"row.`{c}`") for c in pages.columns if c not in new], "host", "path", "rule", F.coalesce("verdict", by_list, F.lit("allow")).alias("verdict"))


#: The registered list, made by a rule and not from the pages: these hosts and their m. and blog. subdomains, in four
#: languages, with the numbers up to LISTED_NUMBERS that three does not divide; 159,984 URLs.
LISTED_HOSTS = ("casino-win.example.com", "spam-farm.example.org")
LISTED_LANGUAGES = ("en", "de", "fr", "es")
LISTED_NUMBERS = 10_000


def listed_urls(spark: SparkSession) -> DataFrame:
    """The registered list (column url)."""
    each = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    numbers = spark.range(LISTED_NUMBERS).where("id % 3 <> 0").select("id", each([f"{sub}{h}" for h in LISTED_HOSTS for sub in ("", "m.", "blog.")]).alias("host"))
    return numbers.select("id", "host", each(LISTED_LANGUAGES).alias("lang")).select(F.format_string("https://%s/%s/%d", "host", "lang", "id").alias("url"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(rest, '') AS rest, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^www\.', '') || regexp_replace(path, '/+$', '') ||
        coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(regexp_replace(rest, '#.*$', '', 's'), '\?(.*)$', 1, 's'), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), ''), '') AS key FROM h),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN host <> '' AND key IN (SELECT sub || h || '/' || lang || '/' || n FROM range(10000) t(n), unnest(['', 'm.', 'blog.']) s(sub), unnest(['casino-win.example.com', 'spam-farm.example.org']) x(h), unnest(['en', 'de', 'fr', 'es']) l(lang) WHERE n % 3 <> 0)
  THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
