"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Eight rules look at the words and lines of a whole text and vote good, bad or abstain. How often
each combination of votes occurs over all documents (at most 3^8 combinations) is counted in
Spark; expectation-maximisation (Dawid and Skene) estimates from these counts how often each rule
votes each way on good and on bad documents, and the share of good ones. A document is kept if the
posterior probability that it is good is at least ``keep_at`` and the base limits hold.

The text is read twice (votes, then verdicts); only the vote counts reach the driver.

Cases: a null or empty text has no words, fails the base limit and is not kept; ids may be null
or repeat (rows are judged one by one, no join on ids); an empty table gives no rows; texts of any
length are read whole; other columns pass through untouched in ``judge`` and are unread in ``rows``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cuefind.llm.common import Words, in_arrow, segment_sum, split_words, text_slices

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PCT = 50
KEEP_AT = 0.5
RULES = 8
#: Very frequent function words of the four languages.
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was",
                  "der", "die", "und", "das", "den", "ist", "nicht", "von", "mit", "ein",
                  "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "pour", "dans",
                  "el", "los", "las", "y", "por", "con", "del", "se", "una", "su"]

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
GOOD, BAD, ABSTAIN = 0, 1, 2


def repeated_words(words: Words) -> np.ndarray:
    """Per word: is it in a 3-word window that the same text has twice or more?"""
    c, n = words.codes, len(words.codes)
    if n < 3:
        return np.zeros(n, bool)
    owner = words.owner()
    inside = owner[:-2] == owner[2:]
    size = np.int64(len(words.vocab) + 1)
    pair = np.unique(c[:-1] * size + c[1:], return_inverse=True)[1]       # exact codes, no hashing
    triple = np.unique(pair[:-1] * size + c[2:], return_inverse=True)[1]
    key = owner[:-2] * np.int64(len(triple) + 1) + triple
    where = np.flatnonzero(inside)
    order = where[np.argsort(key[where], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[np.r_[False, same] | np.r_[same, False]]] = True
    out = twice.copy()
    out[1:] |= twice[:-1]
    out[2:] |= twice[:-2]
    return out


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines that have a word, and those of them equal to an earlier line."""
    parts = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), pattern="\n")
    start = parts.offsets.to_numpy().astype(np.int64)
    start = start - start[0]
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.match_substring_regex(coded.dictionary, "[^ \t-\r]").to_numpy(zero_copy_only=False)[codes]
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    lines = segment_sum(full.astype(np.int64), start)
    key = np.unique(owner[full] * np.int64(len(coded.dictionary) + 1) + codes[full])
    distinct = np.bincount(key // (len(coded.dictionary) + 1), minlength=len(start) - 1)
    return lines, lines - distinct


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts and what the rules need besides, per text."""
    words = split_words(texts)
    v = words.vocab
    per = lambda a: np.asarray(a.to_numpy(zero_copy_only=False)).astype(np.int64)
    lower = pc.utf8_lower(v)
    lines, dup = duplicate_lines(texts)
    owner = words.owner()
    distinct = np.bincount(np.unique(owner * np.int64(len(v) + 1) + words.codes) // (len(v) + 1),
                           minlength=len(words.counts)) if len(owner) else np.zeros(len(words.counts), np.int64)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": words.total(per(pc.utf8_length(v))),
        "n_symbols": words.total(per(pc.count_substring_regex(v, pattern="[#*$%&|<>]"))),
        "n_dup_lines": dup,
        "n_repeat_words": segment_sum(repeated_words(words).astype(np.int64), words.start),
        "lines": lines,
        "distinct": distinct,
        "lettered": words.total(per(pc.match_substring_regex(v, pattern=r"\p{L}"))),
        "function": words.total(per(pc.is_in(lower, value_set=pa.array(FUNCTION_WORDS)))),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of the eight rules (text x rule). A vocabulary is poor below a fifth of the words; from 2,000
    words on, where both bounds are 400, below the square root of 80 times the words."""
    n = m["n_words"]
    some = np.maximum(n, 1)
    rules = [   # (good where, bad where); else the rule abstains
        (n >= BASE_MIN_WORDS, n < BASE_MIN_WORDS),
        ((m["word_chars"] >= 2.5 * n) & (m["word_chars"] <= 12 * n), (m["word_chars"] < 2 * n) | (m["word_chars"] > 16 * n)),
        (m["n_symbols"] * 50 < some, m["n_symbols"] * 8 > some),
        (m["n_dup_lines"] == 0, (m["n_dup_lines"] >= 3) & (m["n_dup_lines"] * 4 > m["lines"])),
        (m["n_repeat_words"] * 6 < some, m["n_repeat_words"] * 3 > some),
        (m["distinct"] * 10 > 3 * n, (m["distinct"] * 5 < n) & (m["distinct"] ** 2 < 80 * n)),
        (m["lettered"] * 100 >= 90 * some, m["lettered"] * 100 < 70 * some),
        (m["function"] * 50 > some, (m["function"] * 200 < some) & (n >= BASE_MIN_WORDS)),
    ]
    return np.stack([np.where(bad | (n == 0), BAD, np.where(good, GOOD, ABSTAIN)) for good, bad in rules], axis=1)


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < BASE_MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_MAX_REPEAT_PCT * m["n_words"])


def _pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(RULES)).sum(axis=1)


def fit(counts: dict[int, int], rounds: int = 200) -> np.ndarray:
    """EM over vote patterns; returns P(good) for each of the 3^RULES patterns.

    Starts from majority votes; each class keeps one imaginary document per rule and vote
    (no estimate is ever 0 or 1), with the diagonal a little heavier, so that the classes
    cannot swap names. With no documents, the posterior is that of the prior alone.
    """
    every = np.arange(3 ** RULES)
    v = (every[:, None] // 3 ** np.arange(RULES)) % 3
    n = np.zeros(len(every))
    for k, c in counts.items():
        n[k] = c
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    p = (good + 1.0) / (good + bad + 1.5)
    onehot = np.stack([v == x for x in (GOOD, BAD, ABSTAIN)], axis=2).astype(float)     # pattern, rule, vote
    prior = np.array([[2.0, 1.0, 1.0], [1.0, 2.0, 1.0]])
    for _ in range(rounds):
        wg, wb = n * p, n * (1 - p)
        share = (wg.sum() + 2) / (n.sum() + 3)
        g = np.tensordot(wg, onehot, 1) + prior[0]
        b = np.tensordot(wb, onehot, 1) + prior[1]
        g, b = g / g.sum(1, keepdims=True), b / b.sum(1, keepdims=True)
        odds = np.log(share / (1 - share)) + np.tensordot(onehot, np.log(g / b), 2)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - p)[n > 0].max(initial=0) < 1e-9
        p = new
        if done:
            break
    return p


def posteriors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Count the vote patterns of all documents and fit; at most 3^RULES rows reach the driver."""
    def kernel(batches):
        for rb in text_slices(batches, text_col):
            pattern, n = np.unique(_pattern(votes(measure(rb.column(text_col)))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64()), pa.array(n, pa.int64())], ["pattern", "n"])

    found = in_arrow(docs.select(text_col), kernel, "pattern long, n long").groupBy("pattern").sum("n").collect()
    return fit({r[0]: r[1] for r in found})


def rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept``, ``posterior`` per document."""
    p = posteriors(docs, text_col)
    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()

    def kernel(batches):
        for rb in text_slices(batches, text_col):
            m = measure(rb.column(text_col))
            failed, good = base_failed(m), p[_pattern(votes(m))]
            yield pa.RecordBatch.from_arrays(
                [rb.column(id_col), *(pa.array(m[x], pa.int64()) for x in FEATURES), pa.array(failed),
                 pa.array(~failed & (good >= keep_at)), pa.array(good)],
                ["doc_id", *FEATURES, "base_failed", "kept", "posterior"])

    return in_arrow(source, kernel, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in FEATURES)
                    + ", base_failed boolean, kept boolean, posterior double")


def judge(docs: DataFrame, *, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    p = posteriors(docs, text_col)

    def kernel(batches):
        for rb in text_slices(batches, text_col):
            m = measure(rb.column(text_col))
            yield rb.filter(pa.array(~base_failed(m) & (p[_pattern(votes(m))] >= keep_at)))

    return in_arrow(docs, kernel, docs.schema)
