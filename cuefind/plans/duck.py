"""DuckDB SQL fragments used by the oracle strings (same semantics as functions/text.py).

These build SQL text for the correctness check only; nothing here runs on Spark.
"""

from __future__ import annotations

from cuefind.functions.text import (EMBED_URL_PREFIX, THUMB_URL_PREFIX, THUMB_URL_SUFFIX, WATCH_URL_PREFIX, WS_CLASS)


def norm(x: str) -> str:
    """DuckDB form of normalize_text."""
    return (f"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '\\p{{P}}+', '', 'g'), "
            f"'{WS_CLASS}+', ' ', 'g'))")


def grams(x: str) -> str:
    """DuckDB form of the trigram set."""
    return (f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), "
            f"'[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), "
            f"lambda i: substring('  ' || w || ' ', i, 3)))))")


def padded(num: str, width: int) -> str:
    """Leading zeros up to ``width`` digits (no truncation)."""
    return f"(repeat('0', greatest(0, {width} - length(CAST({num} AS VARCHAR)))) || CAST({num} AS VARCHAR))"


def chunk_id(num: str) -> str:
    return padded(num, 12)


def video_id(num: str) -> str:
    return padded(num, 11)


def doc_video_id(num: str) -> str:
    return f"('doc' || {padded(num, 8)})"


WATCH = f"'{WATCH_URL_PREFIX}'"
EMBED = f"'{EMBED_URL_PREFIX}'"
THUMB = f"'{THUMB_URL_PREFIX}'"
THUMB_END = f"'{THUMB_URL_SUFFIX}'"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN len({a}) + len({b}) - {inter} = 0 THEN 0.0 "
            f"ELSE CAST({inter} AS DOUBLE) / CAST(len({a}) + len({b}) - {inter} AS DOUBLE) END")


def cos_distance(a: str, b: str) -> str:
    """Cosine distance in double (null for a zero vector)."""
    return f"(1.0 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"


WS = WS_CLASS


def len16(x: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def trim_ws(x: str) -> str:
    """Trim every Unicode whitespace character from both ends."""
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def timespan(ms: str) -> str:
    """TimeSpan text of whole milliseconds."""
    return (f"(CASE WHEN {ms} >= 86400000 THEN CAST({ms} // 86400000 AS VARCHAR) || '.' ELSE '' END || "
            f"printf('%02d:%02d:%02d', ({ms} // 3600000) % 24, ({ms} // 60000) % 60, ({ms} // 1000) % 60) || "
            f"CASE WHEN {ms} % 1000 = 0 THEN '' ELSE printf('.%03d0000', {ms} % 1000) END)")
