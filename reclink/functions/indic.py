"""Transliteration of the nine Brahmic scripts into Latin letters, as one Spark SQL expression.

Unicode lays eight of the scripts out in parallel, so their letters are first moved to the Devanagari block by one
``translate``; Tamil, which has fewer letters, keeps its own values. A consonant then gets its inherent a unless a
vowel sign or a virama follows, signs that follow nothing are dropped, and letters are spelt in Latin: those of one
letter by one ``translate``, the others by ``replace``. The values come from the letters' Unicode names by a rule with
few exceptions. Tokens that are spelt letter names as a whole are acronyms.
"""

from __future__ import annotations

import unicodedata

from .vocabulary import SCRIPTS

DEVA, TAMIL = SCRIPTS["deva"], SCRIPTS["taml"]
SIBLINGS = [k for k in SCRIPTS if k not in ("deva", "taml")]
#: Scripts whose words drop a final inherent a.
NORTHERN = ("deva", "beng", "guru", "gujr", "orya")
# Sounds of letters whose Unicode name says otherwise; nukta variants; letter names of acronyms.
SOUNDS = {"CA": "ch", "CHA": "chh", "SSA": "sh", "VOCALIC R": "ri", "EE": "e", "OO": "o", "SHORT E": "e", "CANDRA E": "e", "SHORT O": "o", "CANDRA O": "o"}
TAMIL_SOUNDS = {"CA": "s", "TA": "th", "SSA": "sh", "EE": "ee", "OO": "oo"}
NUKTA = {"क": "q", "ख": "kh", "ग": "g", "ज": "z", "ड": "r", "ढ": "rh", "फ": "f", "य": "y"}
LETTERS = {
    "ए": "a", "बी": "b", "सी": "c", "डी": "d", "ई": "e", "एफ": "f", "जी": "g", "एच": "h", "आई": "i", "जे": "j", "के": "k", "एल": "l", "एम": "m",
    "एन": "n", "ओ": "o", "पी": "p", "क्यू": "q", "आर": "r", "एस": "s", "टी": "t", "यू": "u", "वी": "v", "डब्ल्यू": "w", "एक्स": "x", "वाई": "y", "जेड": "z",
}
TAMIL_LETTERS = {
    "ஏ": "a", "பி": "p", "சி": "c", "டி": "d", "ஈ": "e", "எஃப்": "f", "ஜி": "g", "எச்": "h", "ஐ": "i", "ஜே": "j", "கே": "k", "எல்": "l", "எம்": "m",
    "என்": "n", "ஓ": "o", "ஆர்": "r", "எஸ்": "s", "யூ": "u", "வி": "v", "எக்ஸ்": "x", "ஒய்": "y",
}
INHERENT = "\ue000"


def _kinds(block: tuple[int, int], sounds: dict[str, str]) -> dict[str, dict[str, str]]:
    """The letters of a block by kind (cons, vowel, matra, sign, virama, nukta, digit), with their sounds."""
    out: dict[str, dict[str, str]] = {k: {} for k in ("cons", "vowel", "matra", "sign", "virama", "nukta", "digit")}
    for c in map(chr, range(block[0], block[1] + 1)):
        name = unicodedata.name(c, "").split(" ", 1)[-1]
        if unicodedata.decimal(c, None) is not None:
            out["digit"][c] = str(unicodedata.decimal(c))
        elif name == "SIGN VIRAMA":
            out["virama"][c] = ""
        elif name == "SIGN NUKTA":
            out["nukta"][c] = ""
        elif name in ("SIGN ANUSVARA", "SIGN CANDRABINDU", "SIGN VISARGA") and block != TAMIL:
            out["sign"][c] = "h" if "VISARGA" in name else "n"
        elif name.startswith(("LETTER ", "VOWEL SIGN ")):
            matra, sound = name.startswith("VOWEL"), name.replace("LETTER ", "").replace("VOWEL SIGN ", "")
            if sound in sounds or set(sound) <= set("AEIOU"):
                heard = sounds.get(sound, sound.lower())
            elif sound.isalpha() and sound.endswith("A"):
                heard = _single(sound[:-1].lower())
            else:
                continue
            vowel = matra or sound[0] in "AEIOUV" and (sound in SOUNDS or set(sound) <= set("AEIOU")) or sound.startswith(("SHORT", "CANDRA"))
            if len(unicodedata.normalize("NFC", c)) == 1 and unicodedata.normalize("NFC", c) == c:
                out["matra" if matra else "vowel" if vowel else "cons"][c] = heard
    return out


def _single(x: str) -> str:
    """Without the doubled letters by which names tell letters of one sound apart."""
    out = ""
    for c in x:
        if not out or out[-1] != c:
            out += c
    return out


def _moves() -> dict[str, str]:
    """Letters of the sibling scripts and the Devanagari letters at their places."""
    known = {c for v in _kinds(DEVA, SOUNDS).values() for c in v}
    out = {}
    for tag in SIBLINGS:
        for c in map(chr, range(SCRIPTS[tag][0], SCRIPTS[tag][1] + 1)):
            twin = chr(ord(c) - SCRIPTS[tag][0] + DEVA[0])
            if unicodedata.name(c, "") and twin in known:
                out[c] = twin
    return out | {"\u0a70": "\u0902", "\u0b5f": "\u092f"}  # Gurmukhi tippi and the Odia letter yya have no twin


def _composed() -> list[tuple[str, str]]:
    """(written, read) of letters that Unicode composes or takes apart in the nine blocks."""
    out = []
    for lo, hi in SCRIPTS.values():
        for c in map(chr, range(lo, hi + 1)):
            parts = unicodedata.normalize("NFD", c)
            if parts != c:
                out.append((parts, c) if unicodedata.normalize("NFC", parts) == c else (c, parts))
    return sorted(out, key=lambda p: -len(p[0]))


def _replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def composed(x: str) -> str:
    return _replaced(x, _composed())


CHILLU = {c: b + "്" for c, b in zip("ൺൻർൽൾൿ", "ണനരലളക", strict=True)}


def token(t: str) -> str:
    """SQL of one token without white space that holds a letter of the nine scripts."""
    d, m = _kinds(DEVA, SOUNDS), _kinds(TAMIL, TAMIL_SOUNDS)
    moves = _moves()
    given = _replaced(t, [("റ്റ", "ട്ട"), *CHILLU.items()])
    given = f"translate({given}, '{''.join(moves)}', '{''.join(moves.values())}')"
    cls = {k: "".join(d[k]) + "".join(m[k]) for k in d}
    x = f"regexp_replace({given}, '([{cls['cons']}][{cls['nukta']}]?+)(?![{cls['virama']}{cls['matra']}])', '$1{INHERENT}')"
    x = f"regexp_replace({x}, '(?<![{cls['cons']}{cls['nukta']}])[{cls['virama']}{cls['matra']}{cls['nukta']}]', '')"
    before = "".join(cls[k] for k in ("cons", "nukta", "virama", "matra", "vowel", "sign")) + INHERENT
    x = f"regexp_replace({x}, '(?<![{before}])[{cls['sign']}]+', '')"
    dot = next(iter(d["nukta"]))
    x = _replaced(x, [(c + dot, sound) for c, sound in NUKTA.items()])
    sounds = {c: v for kinds in (d, m) for k in kinds for c, v in kinds[k].items()} | {INHERENT: "a"}
    x = _replaced(x, [(c, v) for c, v in sounds.items() if len(v) > 1])
    one, none = [(c, v) for c, v in sounds.items() if len(v) == 1], [c for c, v in sounds.items() if not v]
    x = f"translate({x}, '{''.join(c for c, _ in one) + ''.join(none)}', '{''.join(v for _, v in one)}')"
    north = "".join(f"\\x{{{SCRIPTS[k][0]:X}}}-\\x{{{SCRIPTS[k][1]:X}}}" for k in NORTHERN)
    every = f"\\x{{{DEVA[0]:X}}}-\\x{{{SCRIPTS['mlym'][1]:X}}}"
    scanned = f"CASE WHEN rlike({t}, r'^[^{every}]*[{north}]') THEN regexp_replace({x}, r'a(?![\\p{{L}}\\p{{N}}_])', '') ELSE {x} END"
    cases = ""
    for letters in (LETTERS, TAMIL_LETTERS):
        names = sorted(letters, key=len, reverse=True)
        cases += f"WHEN rlike({given}, '^(?>{'|'.join(names)})(?>{'|'.join(names)})+$') THEN {_replaced(given, [(k, letters[k]) for k in names])} "
    return f"CASE {cases}ELSE {scanned} END"


def transliterated(x: str) -> str:
    """SQL of a text; words without a letter of the nine scripts stay."""
    every = f"[\\x{{{DEVA[0]:X}}}-\\x{{{SCRIPTS['mlym'][1]:X}}}]"
    words = f"filter(split({x}, r'\\s+'), w -> w <> '')"
    return f"CASE WHEN rlike({x}, r'{every}') THEN array_join(transform({words}, t -> CASE WHEN rlike(t, r'{every}') THEN {token('t')} ELSE t END), ' ') ELSE {x} END"
