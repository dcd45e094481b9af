"""Scalar text functions as Catalyst expressions (no Python UDFs).

normalize_text: lower -> strip diacritics -> delete punctuation -> collapse whitespace -> trim.
Null and '' pass through unchanged.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's behaviour) -------------------------------
# Whitespace class of the reference's collapse step: \t \n \v \f \r, U+0085 and every
# Unicode separator (Zs, Zl, Zp). Java's \s is ASCII-only, so it is spelled out.
WS_CLASS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
# Video id inside a watch / short / embed URL: 11 characters after "v=" or "/".
VIDEO_ID_PATTERN = r"(?:v=|/)([0-9A-Za-z_-]{11}).*"
WATCH_URL_PREFIX = "https://www.youtube.com/watch?v="
EMBED_URL_PREFIX = "https://www.youtube.com/embed/"
THUMB_URL_PREFIX = "https://img.youtube.com/vi/"
THUMB_URL_SUFFIX = "/hqdefault.jpg"
MAX_QUERY_LENGTH = 64
# -----------------------------------------------------------------------------------------


def _char_class(pred, end: int = 0x10000) -> str:
    """A regex character class of every code point below ``end`` satisfying ``pred``, written as
    ranges. Built from Python's Unicode tables, so the classification does not depend on
    the JVM's Unicode version; the reference tests UTF-16 units, hence the BMP by default."""
    ranges, start, prev = [], None, None
    for cp in range(end):
        ok = not (0xD800 <= cp <= 0xDFFF) and pred(chr(cp))
        if ok and start is None:
            start = cp
        if not ok and start is not None:
            ranges.append((start, prev))
            start = None
        prev = cp
    if start is not None:
        ranges.append((start, prev))
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def _category_class(java_prop: str, pred) -> str:
    """BMP characters of a Unicode category: the JVM's own table for characters it knows,
    and the rule-built class (Python's newer tables) only for code points the JVM treats
    as unassigned (\\p{Cn}); the cheap property test short-circuits the long class."""
    return f"[[{java_prop}&&[\\x{{0}}-\\x{{FFFF}}]][\\p{{Cn}}&&{_char_class(pred)}]]"


#: Fixed value: a spacing mark of today's Unicode that was a non-spacing one in the JVM's version.
_NO_MARK = "\u1734"


def _is_mark(ch: str) -> bool:
    """A non-spacing mark as the reference tests it: by UTF-16 unit, so of the BMP only."""
    return ord(ch) < 0x10000 and unicodedata.category(ch) == "Mn"


@functools.lru_cache(maxsize=1)
def mark_class() -> str:
    """Non-spacing marks (Mn) of the BMP."""
    return _category_class(f"\\p{{Mn}}&&[^{_NO_MARK}]", lambda ch: unicodedata.category(ch) == "Mn")


@functools.lru_cache(maxsize=1)
def punct_class() -> str:
    """Punctuation (Pc Pd Ps Pe Pi Pf Po) of the BMP."""
    return _category_class("\\p{P}", lambda ch: unicodedata.category(ch).startswith("P"))


def lower_char(ch: str) -> str:
    """Invariant lower case: one character to one, whatever stands beside it. U+0130, which has no single
    lower-case letter without a mark, stays."""
    low = ch.lower()
    return low if len(low) == 1 else ch


def _code_points():
    return (chr(cp) for cp in range(0x110000) if not 0xD800 <= cp <= 0xDFFF)


@functools.lru_cache(maxsize=1)
def _lower_map() -> tuple[str, str]:
    changed = [(ch, lower_char(ch)) for ch in _code_points() if lower_char(ch) != ch]
    return "".join(a for a, _ in changed), "".join(b for _, b in changed)


def lower_invariant(c: Column) -> Column:
    return F.translate(c, *_lower_map())


def _stripped(text: str) -> str:
    kept = "".join(c for c in unicodedata.normalize("NFD", text) if not _is_mark(c))
    return unicodedata.normalize("NFC", kept)


@functools.lru_cache(maxsize=2)
def _strip_maps(lower: bool) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Accent-stripped form (NFD, drop non-spacing marks, NFC) of every character that changes, lower-cased
    before if ``lower``: single-character results as a ``translate`` table, the rare multi-character
    results as (char, text) pairs. Characters that vanish are non-spacing marks, removed
    by the regexp. Built from ``unicodedata`` by rule, once per process."""
    src, dst, multi = [], [], []
    for ch in _code_points():
        out = _stripped(lower_char(ch) if lower else ch)
        if out == ch or out == "":
            continue
        if len(out) == 1:
            src.append(ch)
            dst.append(out)
        else:
            multi.append((ch, out))
    return "".join(src), "".join(dst), tuple(multi)


@functools.lru_cache(maxsize=1)
def _joining_class() -> str:
    """Characters that may join or change places with what stands before them once the marks are gone: second
    halves of canonical compositions (vowels and tails of Hangul syllables among them) and marks with a combining
    class that are not dropped."""
    second = {chr(x) for x in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for ch in _code_points():
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and "<" not in parts[0]:
            second.add(chr(int(parts[1], 16)))
    joining = lambda ch: not _is_mark(ch) and (ch in second or unicodedata.combining(ch) > 0)
    first = next(ch for ch in _code_points() if joining(ch))
    # one comparison tells for nearly all characters; the long class is asked for the rest
    return f"[[\\x{{{ord(first):X}}}-\\x{{10FFFF}}]&&{_char_class(joining, 0x110000)}]"


def _strip(c: Column, lower: bool) -> Column:
    """The accents of a text stripped. Character by character (``translate``, ``replace``, a regexp) unless it has
    one of ``_joining_class``; such a text, and only such a one, is decomposed and composed as a whole, by ICU,
    which Spark brings along."""
    src, dst, multi = _strip_maps(lower)
    single = s = F.translate(c, src, dst)
    for ch, out in multi:
        s = F.replace(s, F.lit(ch), F.lit(out))
    s = F.when(c.rlike("[" + "".join(f"\\x{{{ord(ch):X}}}" for ch, _ in multi) + "]"), s).otherwise(single)
    marks = mark_class() + "+"
    icu = lambda method, x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), x, F.lit(False))
    whole = icu("compose", F.regexp_replace(icu("decompose", lower_invariant(c) if lower else c), marks, ""))
    return F.when(c.rlike(_joining_class()), whole).otherwise(F.regexp_replace(s, marks, ""))


def strip_diacritics(c: Column) -> Column:
    """NFD -> drop Mn -> NFC (JVM side)."""
    return _strip(c, lower=False)


def normalize_text(c: Column) -> Column:
    """The reference normalizer as one expression; null and '' pass through. ASCII texts have no accents and need
    only the ASCII part of each class."""
    def tidy(s: Column, punct: str, space: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(s, punct + "+", ""), space + "+", " "))

    ascii_only = tidy(F.lower(c), r"[\p{P}&&[\x00-\x7F]]", r"[\t\n\x0B\f\r ]")
    whole = tidy(_strip(c, lower=True), punct_class(), WS_CLASS)
    return F.when(c.isNull() | (c == F.lit("")), c).when(~c.rlike(r"[^\x00-\x7F]"), ascii_only).otherwise(whole)


@functools.lru_cache(maxsize=1)
def white_space() -> str:
    """The characters of ``WS_CLASS``."""
    return "\t\n\x0b\f\r\x85" + "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "Z")


def clr_trim(c: Column) -> Column:
    """Trim every Unicode whitespace character from both ends (not only ' ')."""
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty, or whitespace only."""
    return c.isNull() | (F.regexp_replace(c, WS_CLASS + "+", "") == F.lit(""))


@functools.lru_cache(maxsize=1)
def word_class() -> str:
    """Letters and digits of all planes: the JVM's table for characters it knows, Python's for
    code points the JVM treats as unassigned. The one table of every trigram set."""
    return f"[\\p{{L}}\\p{{N}}[\\p{{Cn}}&&{_char_class(lambda ch: unicodedata.category(ch)[0] in 'LN', 0x110000)}]]"


def word_text(c: Column) -> Column:
    """The lower-case text with each run of separators as one U+0001, which is never part of a word."""
    return F.regexp_replace(F.lower(c), f"[^{word_class()}]+", "\u0001")


def trigrams(c: Column) -> Column:
    """Distinct trigram set: each word padded as '  w ', then every window of 3 code points.

    One regex pass (codegen, no lambdas): word separators become a sentinel that can never
    be part of a word; a lookahead captures every window that does not cross a sentinel, and the
    match itself takes one code point, so it never starts inside a surrogate pair."""
    t = F.regexp_replace(word_text(c), "^\u0001+|\u0001+$", "")
    padded = F.concat(F.lit("  "), F.regexp_replace(t, "\u0001", " \u0000  "), F.lit(" "))
    grams = F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=([^\u0000]{3}))."), 1))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(grams)


def trigram_similarity(a: Column, b: Column) -> Column:
    """|A∩B| / (|A|+|B|-|A∩B|) over trigram sets; 0 when either set is empty."""
    ga, gb = trigrams(a), trigrams(b)
    inter = F.size(F.array_intersect(ga, gb))
    union = F.size(ga) + F.size(gb) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def extract_video_id(url: Column) -> Column:
    """Group 1 of the id pattern, '' when there is no match."""
    return F.regexp_extract(url, VIDEO_ID_PATTERN, 1)


def watch_url(video_id: Column) -> Column:
    return F.concat(F.lit(WATCH_URL_PREFIX), video_id)


# TimeSpan text: [-]{ [d.]hh:mm[:ss[.fffffff]] | d:hh:mm:ss[.fffffff] } with hour <= 23, minute/second
# <= 59 and up to 8 digits of days. A bare integer (days) is not accepted.
_TIME_FORMS = [
    (r"(?:(\d{1,8})\.)?(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,7}))?)?", ("d", "h", "m", "s", "f")),
    (r"(\d{1,8}):(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,7}))?", ("d", "h", "m", "s", "f")),
]


def parse_timespan_ms(s: Column) -> Column:
    """Parse TimeSpan text to whole milliseconds (towards zero); null when it does not parse. The usual form,
    hh:mm:ss[.fffffff] below a day, is cut by position."""
    two = lambda at: F.substring(s, at, 2).cast("long")
    usual = ((two(1) * 60 + two(4)) * 60 + two(7)) * 1000 + F.rpad(F.substring(s, 10, 3), 3, "0").cast("long")
    return F.when(s.rlike(r"^(?:[01][0-9]|2[0-3])(?::[0-5][0-9]){2}(?:\.[0-9]{1,7})?\z"), usual).otherwise(_any_timespan_ms(s))


def _any_timespan_ms(s: Column) -> Column:
    found = []
    for form, names in _TIME_FORMS:
        pattern = rf"^\s*-?{form}\s*$"
        at = {name: F.regexp_extract(s, pattern, i) for i, name in enumerate(names, 1)}
        part = lambda name: F.when(at[name] == "", F.lit(0)).otherwise(at[name].cast("long"))  # noqa: B023,E731
        ticks = F.when(at["f"] == "", F.lit(0)).otherwise(F.rpad(at["f"], 7, "0").cast("long"))
        ms = (((part("d") * 24 + part("h")) * 60 + part("m")) * 60 + part("s")) * 1000 + F.floor(ticks / 10000).cast("long")
        in_range = (part("h") <= 23) & (part("m") <= 59) & (part("s") <= 59)
        found.append(F.when(s.rlike(pattern) & in_range, ms))
    return F.coalesce(*found) * F.when(s.rlike(r"^\s*-"), F.lit(-1)).otherwise(F.lit(1))
