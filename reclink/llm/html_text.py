"""Operator 10: main text of web pages, with site templates removed.

Pass one hashes the outer markup of a page's block elements (white space normalised, and digits outside
articles) and counts, for each host, the pages on which a subtree recurs. Pass two deletes the subtrees that
recur on many pages: outside ``article`` and ``main`` on at least ``MIN_PAGES`` different pages of the host. Inside, the rule
is stricter: a subtree has to recur with its digits on ``INNER_SHARE`` of the host's pages and ``INNER_PAGES``;
headings and single list items and cells stay, and so does a page whose every passage recurs. Passages that
fewer articles share stay.

What the counts leave is looked at by rules (``rules=False`` turns them off), which decide alone on hosts of too
few pages for counts and on furniture that no two pages share: elements whose tag, role, class or id marks them
as menu, header, footer, sidebar, notice, advert, form or comments go, and of the rest the blocks of the articles
stay (of ``main`` or the body where a page has none).

One plan serves any number of templates: pages are named by a 128-bit hash of host and markup, and each page with
templates that decide gets the list of them by a join. The markup of the others does not move: a bitmap of fixed
size keeps it back. Templates and copies of a page with a large share of all rows are dealt out by salts, and
copies of a page are hashed once for each slice.

Defined cases: null and empty pages give an empty text; a null URL counts as the host ''; unclosed and
truncated markup ends with its parent or the page, an unfinished tag at the end is dropped; repeated rows are
each extracted; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bloom_bitmap, bloom_column, bloom_test, copied, dealt, hot_keys, salted_join, slices, stored, table
from .urls import host_of

MIN_PAGES, INNER_PAGES, INNER_SHARE = 5, 8, 0.5
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<(?=/?[a-zA-Z])[^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside form button select option menu dialog svg canvas object head math".split()) | RAW
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br".split())
#: Elements that can be a template.
INNER = BLOCK - frozenset("article main body html br li dt dd h1 h2 h3 h4 h5 h6 hgroup tr td th thead tbody tfoot".split())
#: Elements that are no template by themselves outside articles, where digits do not count: pages without an article have their text there.
PROSE = frozenset("p blockquote pre center address".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer foot comment comments disqus replies respond share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination pager".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
#: An open element that a start tag of the key's kind ends, within its container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article main section div body html nav aside header footer form table ul ol dl blockquote td th li".split())
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"[0-9]+")


def marked(tag: str, attributes: str) -> bool:
    """Whether tag, role, class, id or hidden mark an element as no main text."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "role" not in attributes and "class" not in attributes and "id" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main") and not HINTS.isdisjoint(SPLIT.split(CAMEL.sub(r"\1-\2", value).lower())):
            return True
    return False


class Element:
    __slots__ = ("tag", "start", "dropped", "inside")

    def __init__(self, tag, start, dropped, inside):
        self.tag, self.start, self.dropped, self.inside = tag, start, dropped, inside


def scan(page: str):
    """Events of a page: ("text", string, stack), ("open", element, stack), ("close", element, end), ("break",)."""
    stack = [Element("", 0, False, 0)]
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], stack
            break
        if m.start() > at:
            yield "text", page[at : m.start()], stack
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in ("br", "p") and all(x.tag != tag for x in stack):
                yield ("break",)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        yield "close", stack.pop(), at if len(stack) == k else m.start()
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS.get(tag, ()) or stack[k].tag == "p" and tag != "br":
                    while len(stack) > k:
                        yield "close", stack.pop(), m.start()
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in VOID:
            if tag in BLOCK:
                yield ("break",)
            continue
        inside = max(stack[-1].inside, 2 if tag == "article" else 1 if tag == "main" or 'role="main"' in attributes else 0)
        element = Element(tag, m.start(), stack[-1].dropped or marked(tag, attributes), inside)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        stack.append(element)
        yield "open", element, stack
    while len(stack) > 1:
        yield "close", stack.pop(), end


def digest(markup: str, inner: bool = False) -> int:
    """Hash of a subtree: odd inside articles, even outside."""
    markup = SPACE.sub(" ", markup)
    h = int.from_bytes(hashlib.blake2b((markup if inner else DIGITS.sub("0", markup)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
    return h | 1 if inner else h & ~1


def countable(e: Element) -> bool:
    return e.tag in INNER and (not e.dropped if e.inside else e.tag not in PROSE)


def subtrees(page: str) -> tuple[set[int], bool]:
    """Hashes of the elements that can be templates and hold no article (of those in ``main`` also), and whether the
    page has text of its own inside ``article`` or ``main``."""
    out, holds, inner = set(), set(), False
    for event in scan(page):
        if event[0] == "open":
            if event[1].inside:
                holds.update(id(x) for x in event[2] if x.inside < event[1].inside)
        elif event[0] == "close":
            e = event[1]
            if countable(e) and id(e) not in holds:
                out.add(digest(page[e.start : event[2]], e.inside > 0))
        elif event[0] == "text" and not inner:
            e = event[2][-1]
            inner = e.inside > 0 and not e.dropped and not html.unescape(event[1]).isspace()
    return out, inner


def main_text(page: str | None, templates=frozenset(), rules: bool = True) -> str:
    if not page:
        return ""
    blocks: list[tuple[int, bool, str]] = []  # (0 outside, 1 in main, 2 in an article; marked by the rules; text)
    gone: set[int] = set()
    opened: dict[int, int] = {}
    current: list[str] = []
    level, dropped = 0, False

    def flush():
        nonlocal current
        if current:
            text = SPACE.sub(" ", html.unescape("".join(current))).strip()
            if text:
                blocks.append((level, dropped, text))
            current = []

    for event in scan(page):
        kind = event[0]
        if kind == "text":
            e = event[2][-1]
            if e.inside != level or e.dropped != dropped:
                flush()
                level, dropped = e.inside, e.dropped
            current.append(event[1])
        elif kind == "break":
            flush()
        elif event[1].tag in BLOCK:
            flush()
            e = event[1]
            if templates and countable(e):
                if kind == "open":
                    opened[id(e)] = len(blocks)
                else:
                    own = range(opened.pop(id(e), len(blocks)), len(blocks))
                    if own and all(blocks[i][0] == e.inside for i in own) and digest(page[e.start : event[2]], e.inside > 0) in templates:
                        gone.update(own)
    flush()
    if not rules:
        return " ".join(x for i, (_, _, x) in enumerate(blocks) if i not in gone)
    for k in (2, 1):
        if own := [i for i, (at, marked, _) in enumerate(blocks) if at == k and not marked]:
            return " ".join(blocks[i][2] for i in ([i for i in own if i not in gone] or own))
    return " ".join(x for i, (_, marked, x) in enumerate(blocks) if not marked and i not in gone)


def hosts(pages: DataFrame, url: str, markup: str) -> DataFrame:
    """page_id, url, text and the page's name (host, p, q)."""
    given = pages.select(F.col("page_id"), F.col(url).alias("url"), F.coalesce(host_of(F.col(url).cast("string")), F.lit("")).alias("host"), F.col(markup).cast("string").alias("text"))
    return given.withColumn("p", F.xxhash64("host", "text")).withColumn("q", F.xxhash64("text", F.lit(1), "host"))


def page_subtrees(given: DataFrame) -> DataFrame:
    """(host, p, q, c, subtrees, inner): the distinct pages, their copies and what ``subtrees`` says of them."""

    def run(batches):
        for part in slices(batches):
            seen: dict = {}
            for host, p, q, page in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if (p, q) in seen:
                    seen[p, q][1] += 1
                else:
                    own, inner = subtrees(page) if page else (set(), False)
                    seen[p, q] = [host, 1, sorted(own), inner]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            values = [pa.array([v[i] for v in seen.values()], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in seen], pa.int64()) for i in (0, 1)], *values], names=["p", "q", "host", "c", "subtrees", "inner"])

    each = given.select("host", "p", "q", "text").mapInArrow(run, "p long, q long, host string, c long, subtrees array<long>, inner boolean")
    return stored(each.groupBy("p", "q").agg(F.any_value("host").alias("host"), F.sum("c").alias("c"), F.any_value("subtrees").alias("subtrees"), F.any_value("inner").alias("inner")), "page-subtrees")


def templates(found: DataFrame) -> DataFrame:
    """(host, subtree, c): the subtrees that recur, with the number of pages that differ and hold them."""
    pages = found.groupBy("host").agg(F.sum("c").alias("all"))
    counts = found.select("host", "c", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.sum("c").alias("n"), F.count("*").alias("c")).where((F.col("c") >= MIN_PAGES) | (F.col("n") >= INNER_PAGES))
    per_host = pages.join(counts.groupBy("host").agg(F.count("*").alias("c")).hint("merge"), "host")
    inner = F.col("subtree").bitwiseAND(1) == 1
    # The templates of a host with a third of all pages are dealt out too.
    judged = salted_join(counts.withColumnRenamed("c", "different"), per_host, ["host"], max(1, found.count()), ["subtree"]).withColumnRenamed("different", "c")
    often = F.when(inner, (F.col("n") >= INNER_PAGES) & (F.col("n") >= INNER_SHARE * F.col("all"))).otherwise(F.col("c") >= MIN_PAGES)
    return judged.where(often).select("host", "subtree", "c")


def extract(pages: DataFrame, url: str = "url", markup: str = "html", rules: bool = True) -> DataFrame:
    """page_id, url, text."""
    given = hosts(pages, url, markup)
    found = page_subtrees(given)
    known = stored(templates(found), "page-templates")
    # With rules, text inside an article or main decides alone: then templates outside it change nothing.
    deciding = F.filter("subtrees", lambda x: (x.bitwiseAND(1) == 1) == F.col("inner")) if rules else F.col("subtrees")
    held = found.select("host", "p", "q", F.col("c").alias("copies"), F.explode(deciding).alias("subtree"))
    total = found.agg(F.sum(F.size("subtrees")), F.sum("c")).first()
    own = salted_join(held, known, ["host", "subtree"], total[0] or 1, ["p", "q"]).groupBy("p", "q").agg(F.collect_set("subtree").alias("own"), F.max("copies").alias("c"))  # a page's elements at most
    own = stored(own, "page-own")
    bitmap = bloom_bitmap(own, "p")

    def plain(batches):
        for part in slices(batches):
            hit = bloom_test(bitmap, part.column(5).to_numpy(zero_copy_only=False))
            whole = part.column(2).to_pylist()
            texts = [None if h else main_text(page, frozenset(), rules) for page, h in zip(whole, hit, strict=True)]
            kept = [page if h else None for page, h in zip(whole, hit, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(kept, pa.string()), part.column(3), part.column(4), pa.array(hit), pa.array(texts, pa.string())], names=["page_id", "url", "markup", "p", "q", "hit", "text"])

    def cut(batches):
        for part in slices(batches, text="markup"):
            texts = [main_text(page, set(own or ()), rules) for page, own in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    # Most markup never moves: a bitmap of fixed size names the pages that may hold a template that decides.
    rows = given.select("page_id", "url", F.col("text").alias("markup"), "p", "q", bloom_column("p").alias("bit"))
    schema = T.StructType([*rows.schema.fields[:5], *T._parse_datatype_string("hit boolean, text string").fields])
    once = stored(rows.withColumnRenamed("markup", "text").mapInArrow(plain, schema), "page-texts")
    hot = hot_keys(own.select("p", "q", "c"), total[1] or 1)
    again = dealt(once.where("hit"), hot, ["p", "q"], ["page_id"]).join(copied(own, total[1] or 1).hint("merge"), ["p", "q", "salt"], "left").select("page_id", "url", "markup", "own")
    out = once.where("not hit").select("page_id", "url", "text")
    return out.unionByName(again.mapInArrow(cut, out.schema))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
