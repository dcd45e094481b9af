"""The verdicts of op1 and the scores of op4 against plain versions that go document by document and word by word."""
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import regex

from cuefind.llm import mil_classifier as mil
from cuefind.llm import quality_rules as qr
from cuefind.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def repeated(words):
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    return [any(0 <= s <= len(words) - 3 and seen[tuple(words[s:s + 3])] > 1 for s in (i - 2, i - 1, i)) for i in range(len(words))]


# ---- op1 ----------------------------------------------------------------------------------------

def plain_votes(text):
    """The eight votes of one text ('g', 'b' or '-'), and whether it fails the base limits."""
    text = text or ""
    words = WORD.findall(text)
    n, some = len(words), max(len(words), 1)
    chars = sum(map(len, words))
    symbols = sum(c in "#*$%&|<>" for w in words for c in w)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    again = sum(repeated(words))
    distinct = len(set(words))
    lettered = sum(bool(regex.search(r"\p{L}", w)) for w in words)
    function = sum(w.lower() in qr.FUNCTION_WORDS for w in words)
    rules = [
        (n >= 50, n < 50),
        (2.5 * n <= chars <= 12 * n, chars < 2 * n or chars > 16 * n),
        (symbols / some < 1 / 50, symbols / some > 1 / 8),
        (dup == 0, dup >= 3 and dup > len(lines) / 4),
        (again < some / 6, again > some / 3),
        (distinct > 0.3 * n, distinct < n / 5 and distinct < math.sqrt(80 * n)),
        (lettered >= 0.9 * some, lettered < 0.7 * some),
        (function > some / 50, function < some / 200 and n >= 50)]
    return ["b" if bad or not n else "g" if good else "-" for good, bad in rules], n < 50 or 100 * again > 50 * n


def plain_em(votes, rounds=200):
    """EM over documents, one at a time: the posterior that each is good."""
    p = [(v.count("g") + 1) / (v.count("g") + v.count("b") + 1.5) for v in votes]
    for _ in range(rounds):
        share = (sum(p) + 2) / (len(p) + 3)
        odds = [math.log(share / (1 - share))] * len(votes)
        for r in range(8):
            good, bad = {"g": 2.0, "b": 1.0, "-": 1.0}, {"g": 1.0, "b": 2.0, "-": 1.0}
            for v, q in zip(votes, p):
                good[v[r]] += q
                bad[v[r]] += 1 - q
            ratio = {x: math.log(good[x] / sum(good.values()) / (bad[x] / sum(bad.values()))) for x in "gb-"}
            odds = [o + ratio[v[r]] for o, v in zip(odds, votes)]
        new = [1 / (1 + math.exp(-min(max(o, -500), 500))) for o in odds]
        done = max(abs(a - b) for a, b in zip(new, p)) < 1e-9
        p = new
        if done:
            break
    return p


def check_rules(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    marks = [plain_votes(t) for _, t in texts]
    posterior = plain_em([v for v, _ in marks])
    want = sorted(((str(i), failed, not failed and p >= 0.5, p) for (i, _), (_, failed), p in zip(texts, marks, posterior)))
    got = sorted((str(r["doc_id"]), r["base_failed"], r["kept"], r["posterior"]) for r in qr.rows(docs).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-6)
    return want


def test_rules_on_real_documents(spark):
    want = check_rules(table(spark, SF, "documents", "doc_id", "text"))
    assert 0.02 < sum(not x[2] for x in want) / len(want) < 0.6


def test_rules_on_awkward_documents(make_docs, awkward):
    poor = " ".join(f"w{k % 30}" for k in range(2500))
    check_rules(make_docs(awkward + [(500, poor), (501, "$ % # " * 60), (502, "\n".join(["the same line of it"] * 20)), (503, "the of and 1 2 3 " * 12)]))


# ---- op4 ----------------------------------------------------------------------------------------

def plain_features(text):
    """The feature rows of one text's passages, word by word."""
    words = WORD.findall(text or "")
    twice = repeated(words)
    out = []
    for a in range(0, max(len(words), 1), mil.PASSAGE):
        own = words[a:a + mil.PASSAGE]
        row = np.zeros(mil.FEATURES)
        for w, again in zip(own, twice[a:a + mil.PASSAGE]):
            low = w.lower()
            share = lambda p: len(regex.findall(p, w)) / len(w)  # noqa: B023,E731
            h = int(pd.util.hash_array(np.array([low], dtype=object), hash_key="cuefind-mil-word", categorize=False)[0])
            one = [len(w) / 8, share(r"\p{L}"), share("[0-9]"), share("[#*$%&|<>]"), share("[.,;:!?]"),
                   bool(regex.search(r"^\p{Lu}", w)), bool(regex.search(r"^\p{Lu}{2,}$", w)),
                   bool(re.search("@|://|www", w)), low in qr.FUNCTION_WORDS] + [0] * mil.HASHED + [again]
            one[9 + h % mil.HASHED] = 1.0 if h >> 63 else -1.0
            row[:len(one)] += np.array(one, float) / len(own)
        row[-3] = len(set(own)) / max(len(own), 1)
        row[-2] = math.log1p(len(own)) / math.log1p(mil.PASSAGE)
        row[-1] = not own
        out.append(row)
    return out


def plain_score(model, text):
    """Encode each passage, gate it, soft-max, add up, score: with loops over one document."""
    sigmoid = lambda z: 1 / (1 + math.exp(-min(max(z, -50), 50)))
    hidden, energy = [], []
    for row in plain_features(text):
        x = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale)]
        h = [math.tanh(sum(a * b for a, b in zip(x, model.p["W"][:, k])) + model.p["b"][k]) for k in range(mil.HIDDEN)]
        gate = [math.tanh(sum(a * b for a, b in zip(h, model.p["V"][:, g]))) * sigmoid(sum(a * b for a, b in zip(h, model.p["U"][:, g])))
                for g in range(mil.GATE)]
        hidden.append(h)
        energy.append(sum(a * b for a, b in zip(gate, model.p["w"])))
    weight = [math.exp(e - max(energy)) for e in energy]
    bag = [sum(w * h[k] for w, h in zip(weight, hidden)) / sum(weight) for k in range(mil.HIDDEN)]
    return sigmoid(sum(a * b for a, b in zip(bag, model.p["c"])) + model.p["d"][0])


@pytest.fixture(scope="module")
def model(spark):
    return mil.fit(table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text"),
                   table(spark, "/root/testdata/sf0.01", "labels", "doc_id", "quality"))


def test_scores_on_real_documents(spark, model):
    docs = table(spark, SF, "documents", "doc_id", "text").limit(60)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in mil.rows(table(spark, SF, "documents", "doc_id", "text"), model).collect() if r["doc_id"] in texts}
    for i, text in texts.items():
        assert got[i] == pytest.approx(plain_score(model, text), abs=2e-4)


def test_scores_on_awkward_documents(make_docs, awkward, model):
    some = [(i, t) for i, t in awkward if len(t or "") < 20_000]
    got = Counter((str(r["doc_id"]), round(r["score"], 3)) for r in mil.rows(make_docs(some), model).collect())
    want = [(str(i), plain_score(model, t)) for i, t in some]
    assert sum(got.values()) == len(want)
    for i, s in want:
        assert any(k == i and abs(v - s) < 2e-3 for k, v in got)
