import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, extra string, words int, slot string, kept string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with results."""
    def make(pairs):
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", 1, "s", "k") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)
    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and very long texts, ties, repeated rows."""
    base = " ".join(f"word{k % 400}x{k % 7}" for k in range(600))
    return [
        (1, base), (2, base), (3, base.replace("word5x5 ", "", 1)), (4, None), (5, ""), (6, " \n\t "), (None, "no id at all here"),
        (7, "a b c"), (8, "a b c"), (9, "a  b\tc"), (10, "one\ntwo\n\none\n"), (10, "one\ntwo\n\none\n"),
        (11, "é" * 3000 + " " + "long " * 3000), (12, "x" * 50_000), (123456789012, "漢字 😀 $$$ <|endoftext|> don't"),
        (-5, "negative id " + base[:900]),
    ]
