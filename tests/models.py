"""Plain-Python models of the operator semantics, used as brute-force references."""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata

_WS = "\t\n\x0b\x0c\r\x85"


def is_ws(ch: str) -> bool:
    return ch in _WS or unicodedata.category(ch) in ("Zs", "Zl", "Zp")


def clr_trim(s: str) -> str:
    i, j = 0, len(s)
    while i < j and is_ws(s[i]):
        i += 1
    while j > i and is_ws(s[j - 1]):
        j -= 1
    return s[i:j]


def utf16_len(s: str) -> int:
    return sum(2 if ord(c) > 0xFFFF else 1 for c in s)


def chunk_model(segments, thresholds=(30, 50)):
    """Chunks of one video as sets and indexes: (threshold, first segment, text, start, end).

    With the lengths' prefix sums, segment k is in the chunk of i if it starts less than the threshold
    after i. Per threshold, a start is new if no earlier start, here or among the chunks of an earlier
    threshold, has its (text, start, end); starts after the first new one that reaches the end don't count."""
    texts = [s[0] for s in segments]
    before = list(itertools.accumulate(map(utf16_len, texts), initial=0))[:-1]
    out, known = [], set()
    for t in thresholds:
        last = [bisect.bisect_right(before, b + t - 1) - 1 for b in before]
        keys = [(clr_trim(" ".join(texts[i:k + 1])), segments[i][1], segments[k][2]) for i, k in enumerate(last)]
        new = [i for i, key in enumerate(keys) if key not in known and keys.index(key) == i]
        stop = min((i for i in new if last[i] == len(segments) - 1), default=len(segments))
        chosen = [i for i in new if i <= stop]
        out += [(t, i, *keys[i]) for i in chosen]
        known |= {keys[i] for i in chosen}
    return out


def normalize_model(s):
    if s is None or s == "":
        return s
    s = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)       # invariant: no context
    d = unicodedata.normalize("NFD", s)
    # categories are tested per UTF-16 unit: only BMP non-spacing marks are dropped
    s = unicodedata.normalize("NFC", "".join(c for c in d if not (ord(c) <= 0xFFFF and
                                                                  unicodedata.category(c) == "Mn")))
    s = "".join(c for c in s if not (ord(c) <= 0xFFFF and unicodedata.category(c).startswith("P")))
    out, prev_ws = [], False
    for c in s:
        if is_ws(c):
            if not prev_ws:
                out.append(" ")
            prev_ws = True
        else:
            out.append(c)
            prev_ws = False
    return "".join(out).strip(" ")


def trigram_set(s: str) -> set:
    words = [w for w in re.split(r"[^\w]|_", s.lower()) if w]
    grams = set()
    for w in words:
        p = "  " + w + " "
        for i in range(len(p) - 2):
            grams.add(p[i:i + 3])
    return grams


def trigram_sim(a: str, b: str) -> float:
    ga, gb = trigram_set(a), trigram_set(b)
    inter = len(ga & gb)
    union = len(ga) + len(gb) - inter
    return 0.0 if union == 0 else inter / union


def parse_timespan_ms(s: str):
    """[-]{ [d.]hh:mm[:ss[.fffffff]] | d:hh:mm:ss[.fffffff] } in whole milliseconds."""
    t = s.strip()
    sign, t = (-1, t[1:]) if t.startswith("-") else (1, t)
    rest, days, frac = t, "0", ""
    if t.count(":") == 3:
        days, _, rest = t.partition(":")
    elif re.match(r"\d+\.\d+:", t):
        days, _, rest = t.partition(".")
    if "." in rest:
        rest, _, frac = rest.partition(".")
        if rest.count(":") != 2 or not re.fullmatch(r"\d{1,7}", frac):
            return None
    parts = rest.split(":")
    if not re.fullmatch(r"\d{1,8}", days) or not 2 <= len(parts) <= 3 or not all(re.fullmatch(r"\d{1,2}", p) for p in parts) \
            or (t.count(":") == 3 and len(parts) != 3):
        return None
    h, m, sec = [int(p) for p in parts] + [0] * (3 - len(parts))
    if h > 23 or m > 59 or sec > 59:
        return None
    return sign * ((((int(days) * 24 + h) * 60 + m) * 60 + sec) * 1000 + int(frac.ljust(7, "0") if frac else 0) // 10000)


def subtitles_model(text: str, first_match: bool = True):
    """Cue parse of one file: list of (text, start_ms, end_ms)."""
    lines = text.split("\n")
    lines = [ln[:-1] if ln.endswith("\r") else ln for ln in lines]
    if lines and lines[-1] == "" and text.endswith("\n"):
        lines = lines[:-1]
    out = []
    for idx, line in enumerate(lines):
        if " --> " not in line:
            continue
        parts = line.split(" --> ")
        a, b = parse_timespan_ms(parts[0]), parse_timespan_ms(parts[1])
        if a is None or b is None:
            continue
        start = lines.index(line) if first_match else idx
        body = []
        for ln in lines[start + 1:]:
            if ln.strip() == "" or all(is_ws(c) for c in ln):
                break
            body.append(ln)
        out.append((" ".join(body), a, b))
    return out
