"""Expressions of the engine, written once for Spark SQL and once for the SQL engine that results are held against.

A query is a function of a dialect. Spark runs it as one declarative plan; nothing leaves the JVM."""

from __future__ import annotations

import unicodedata

from . import indic
from . import vocabulary as V


def _marks() -> tuple[str, str]:
    """Latin letters with diacritics and the letters that are left when the diacritics go."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not 0x300 <= ord(x) <= 0x36F)
        if len(base) == 1 and base != chr(c):
            pairs.append((chr(c), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


class Dialect:
    """What the two dialects share."""

    def words(self, x):
        return self.keep(self.split(x), "w", "w <> ''")

    def clean(self, x):
        """Folded, lower-cased, without punctuation, ordinals' endings and leading zeros."""
        x = f"lower({self.rx(self.fold(x), '^[ \t\n\r-]+|[ \t\n\r-]+$', '')})"
        x = self.rx(f"replace({x}, '&', ' and ')", "['’ʼ`]", "")
        x = self.rx(x, "[।॥]", " ")
        x = self.rx(x, r"[^\p{L}\p{N}\s\x{900}-\x{DFF}]", " ")
        x = self.rx(x, r"([0-9])(?:st|nd|rd|th)\b", self.group)
        x = self.rx(x, r"\b0+([0-9])", self.group)
        return f"trim({self.rx(x, r'\s+', ' ')})"

    def sorted_words(self, x):
        return self.join(self.sort(self.distinct(self.words(x))))

    def legal(self, x):
        for form, short in V.LEGAL_FORMS:
            x = self.rx(x, rf"\b{form}\b", short)
        return x

    def core(self, x):
        """Without legal tokens, or whole where nothing else is left."""
        names = ", ".join(f"'{t}'" for t in V.LEGAL_TOKENS)
        left = self.join(self.keep(self.words(x), "w", f"w NOT IN ({names})"))
        return f"CASE WHEN {left} = '' THEN {x} ELSE {left} END"

    def core_words(self, w, names):
        """The words of an array without legal tokens, or all where nothing else is left."""
        left = self.keep(w, "t", f"t NOT IN ({names})")
        return f"CASE WHEN {self.size(left)} = 0 THEN {w} ELSE {left} END"

    def let(self, x, v, body):
        """``body`` with ``x`` computed once, under the name ``v``."""
        return self.first(self.map(self.array(x), v, body))

    def phonetic(self, x):
        x = f"lower({x})"
        for a, b in V.DIGRAPHS:
            x = f"replace({x}, '{a}', '{b}')"
        x = self.rx(x, "c([eiy])", "s" + self.group)
        x = f"replace({x}, 'c', 'k')"
        x = f"translate({x}, '{''.join(a for a, _ in V.SINGLES)}', '{''.join(b for _, b in V.SINGLES)}')"
        return self.runs(f"replace({x}, '\x01', 'c')")

    def skeleton(self, x):
        """Consonants of the phonetic key; a vowel in front of a word stays as an a."""
        x = self.rx(self.phonetic(x), r"(^|\s)[aeiou]", self.group + "A")
        return self.runs(f"lower({self.rx(x, '[aeiou]', '')})")

    def runs(self, x):
        for c in "abcdefghijklmnopqrstuvwxyz0123456789ßæœøđłþð":
            x = self.rx(x, f"{c}{c}+", c)
        return x

    def country(self, x):
        cases = " ".join(f"WHEN {self.clean(x)} IN ({', '.join(repr(a) for a in names)}) THEN '{code}'" for code, names in V.COUNTRY_ALIASES.items())
        return f"CASE {cases} ELSE trim({x}) END"

    def scripts(self, x):
        """The scripts of a text's letters, sorted."""
        cases = [f"CASE WHEN {self.like(x, f'{self.alpha}[\\x{{{a:X}}}-\\x{{{b:X}}}]')} THEN '{name}' END" for name, (a, b) in V.SCRIPTS.items()]
        cases.append(f"CASE WHEN {self.like(x, r'[A-Za-zªµºÀ-ÖØ-öø-ɏ]')} THEN 'latin' END")
        return self.sort(self.keep(self.array(*cases), "s", "s IS NOT NULL"))

    def party(self):
        """Documents as dirty records: entity_id, source, country, name (six words), address (the next twelve)."""
        w = self.words("regexp_replace(text, '[\\s]+', ' ')" if self.name == "spark" else "regexp_replace(text, '[\\s]+', ' ', 'g')").replace("'[\\s]+'", "r'[\\s]+'" if self.name == "spark" else "'[\\s]+'")
        return f"""party AS (SELECT doc_id, concat('S', CAST(1 + doc_id % 3 AS VARCHAR(20)), '-', CAST(doc_id AS VARCHAR(20))) AS entity_id, CAST(1 + doc_id % 3 AS BIGINT) AS source, lang AS country,
          {self.join(self.part('w', 1, 6))} AS name, {self.join(self.part('w', 7, 12))} AS address FROM (SELECT doc_id, lang, {w} AS w FROM documents) d)"""

    def grams(self, x, n=3):
        """Distinct n-grams of ^word$ for all words, sorted."""
        inner = self.map(self.words(x), "w", f"concat('^', w, '$')")
        cut = self.map(inner, "v", self.map(self.span("1", f"greatest(1, length(v) - {n - 1})"), "i", f"substring(v, CAST(i AS INT), {n})"))
        return self.sort(self.distinct(f"flatten({cut})"))

    def bigrams(self, x):
        return self.distinct(self.map(self.span("1", f"greatest(1, length({x}) - 1)"), "i", f"substring({x}, CAST(i AS INT), 2)"))

    def jaccard(self, a, b):
        common, union = self.size(self.intersect(a, b)), self.size(self.distinct(self.concat(a, b)))
        return f"CASE WHEN {self.size(a)} = 0 OR {self.size(b)} = 0 THEN 0.0 ELSE round(CAST({common} AS DOUBLE) / {union}, 6) END"


class Spark(Dialect):
    name, group, alpha = "spark", "$1", r"(?=\p{L})"

    def text(self, s):
        return "r'" + s.replace("'", "\\x27") + "'"

    def rx(self, x, pattern, to):
        return f"regexp_replace({x}, {self.text(pattern)}, '{to}')"

    def like(self, x, pattern):
        return f"rlike({x}, {self.text(pattern)})"

    def extract(self, x, pattern, group=1):
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def all(self, x, pattern):
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def fold(self, x):
        """Without Latin diacritics; letters of the nine scripts composed, or taken apart, as NFC has them."""
        a, b = _marks()
        return f"regexp_replace(translate({x}, '{a}', '{b}'), r'[\\x{{300}}-\\x{{36F}}]', '')"

    def compose(self, x):
        return f"CASE WHEN rlike({x}, r'[\\x{{900}}-\\x{{D7F}}]') THEN {indic.composed(x)} ELSE {x} END"

    def translit(self, x):
        return indic.transliterated(x)

    def runs(self, x):
        return f"regexp_replace({x}, r'(.)\\1+', '$1')"

    def lookup(self, table, key):
        return f"map({', '.join(f'{a!r}, {b!r}' for a, b in table.items())})[{key}]"

    def last(self, a):
        return f"try_element_at({a}, -1)"

    def first(self, a):
        return f"get({a}, 0)"

    def places(self, a, v, body):
        """Places (from 0) of the elements of which ``body`` is true."""
        return f"filter(transform({a}, ({v}, i_) -> CASE WHEN {body} THEN i_ END), i_ -> i_ IS NOT NULL)"

    def without(self, a, at):
        """All elements but that at a place, which can be null."""
        return f"filter({a}, (x_, i_) -> {at} IS NULL OR i_ <> {at})"

    def has(self, a, x):
        return f"array_contains({a}, {x})"

    def letter(self, x):
        return f"rlike({x}, r'\\p{{L}}')"

    def split(self, x, by=" "):
        return f"split({x}, '{by}')"

    def keep(self, a, v, body):
        return f"filter({a}, {v} -> {body})"

    def map(self, a, v, body):
        return f"transform({a}, {v} -> {body})"

    def sort(self, a):
        return f"array_sort({a})"

    def distinct(self, a):
        return f"array_distinct({a})"

    def join(self, a, by=" "):
        return f"array_join({a}, '{by}')"

    def size(self, a):
        return f"CAST(size({a}) AS BIGINT)"

    def part(self, a, begin, n):
        return f"slice({a}, {begin}, {n})"

    def span(self, a, b):
        return f"sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"

    def intersect(self, a, b):
        return f"array_intersect({a}, {b})"

    def concat(self, a, b):
        return f"concat({a}, {b})"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def struct(self, **xs):
        return f"named_struct({', '.join(f"'{k}', {x}" for k, x in xs.items())})"

    def explode(self, a, alias, col):
        return f", LATERAL explode({a}) AS {alias}({col})"

    def hash32(self, x):
        return f"CAST(conv(substring(md5({x}), 1, 8), 16, 10) AS BIGINT)"

    def quantile(self, q, x):
        return f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})"

    def json(self, x, key):
        return f"get_json_object({x}, '$.{key}')"


class Duck(Dialect):
    name, group, alpha = "duck", "\\1", ""

    def text(self, s):
        return "'" + s.replace("'", "''") + "'"

    def rx(self, x, pattern, to):
        return f"regexp_replace({x}, {self.text(pattern)}, '{to}', 'g')"

    def like(self, x, pattern):
        return f"regexp_matches({x}, {self.text(pattern)})"

    def extract(self, x, pattern, group=1):
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def all(self, x, pattern):
        return f"regexp_extract_all({x}, {self.text(pattern)})"

    def fold(self, x):
        return f"strip_accents({x})"

    def compose(self, x):
        return x

    def translit(self, x):
        """The tables hold no letter of the nine scripts; literal rows test that path."""
        return x

    def lookup(self, table, key):
        return f"(map {{{', '.join(f'{a!r}: {b!r}' for a, b in table.items())}}})[{key}]"

    def last(self, a):
        return f"list_last({a})"

    def first(self, a):
        return f"list_first({a})"

    def places(self, a, v, body):
        return f"list_filter(list_transform({a}, lambda {v}, i_: CASE WHEN {body} THEN i_ - 1 END), lambda i_: i_ IS NOT NULL)"

    def without(self, a, at):
        return f"list_filter({a}, lambda x_, i_: {at} IS NULL OR i_ - 1 <> {at})"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def letter(self, x):
        return f"regexp_matches({x}, '[\\p{{L}}]')"

    def split(self, x, by=" "):
        return f"string_split({x}, '{by}')"

    def keep(self, a, v, body):
        return f"list_filter({a}, lambda {v}: {body})"

    def map(self, a, v, body):
        return f"list_transform({a}, lambda {v}: {body})"

    def sort(self, a):
        return f"list_sort({a})"

    def distinct(self, a):
        return f"list_distinct({a})"

    def join(self, a, by=" "):
        return f"array_to_string({a}, '{by}')"

    def size(self, a):
        return f"CAST(len({a}) AS BIGINT)"

    def part(self, a, begin, n):
        return f"{a}[{begin}:{begin + n - 1}]"

    def span(self, a, b):
        return f"range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1)"

    def intersect(self, a, b):
        return f"list_intersect({a}, {b})"

    def concat(self, a, b):
        return f"list_concat({a}, {b})"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def struct(self, **xs):
        return f"{{{', '.join(f"'{k}': {x}" for k, x in xs.items())}}}"

    def explode(self, a, alias, col):
        return f", unnest({a}) AS {alias}({col})"

    def hash32(self, x):
        return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"

    def quantile(self, q, x):
        return f"quantile_disc({x}, {q})"

    def json(self, x, key):
        return f"json_extract_string({x}, '$.{key}')"


SPARK, DUCK = Spark(), Duck()
