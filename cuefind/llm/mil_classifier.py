"""Quality classifier: multiple-instance learning with gated attention.

A document is a bag of passages (``PASSAGE`` words each); only the document has a label. Every
passage of the whole text is encoded by one tanh layer over counted features; gated attention
(tanh times sigmoid, soft-maxed over the document's passages) weighs the encodings, and a logistic
unit scores their weighted sum. All layers are learned together from document labels, so the model
finds out by itself which passages decide.

Features come from the words alone (kinds of characters, function words, hashed frequent words, repeats
inside the document): never from labels, language, source or id.

Training is on a bounded sample, the documented parameters ``TRAIN_DOCUMENTS`` (labelled documents,
chosen by a hash of the id) and ``TRAIN_TOTAL`` (passages of all of them: documents are taken in the order
of that hash, each with all its passages, as long as they fit), never on the held-out fold (crc32 of the id
as text, mod 3, is 1). An id with several texts has one of them, the smallest. Scoring reads every
passage of every document.

Cases: a null or empty text is one empty passage and gets a score like any other; a null id is not
held out; rows may repeat; null, repeated or conflicting labels of an id are averaged (nulls left out);
without labelled documents, or with one class only, all scores are the smoothed share of good labels;
an empty table gives no rows; other columns are not read (``accept`` passes them through).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefind.llm.common import Words, in_arrow, materialise, split_words, text_slices
from cuefind.llm.quality_rules import FUNCTION_WORDS, repeated_words

PASSAGE = 128
TRAIN_DOCUMENTS = 6000
TRAIN_TOTAL = 1 << 18
HASHED = 24
HIDDEN, GATE = 16, 8
EPOCHS = 250
#: Text bytes whose words get their features at a time (a word has 34 numbers).
SLICE_BYTES = 1 << 19
_RATE, _DECAY, _SEED = 0.02, 1e-4, 11


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _word_features(words: Words) -> np.ndarray:
    """What each vocabulary entry says (entry x feature)."""
    v = words.vocab
    if not len(v):
        return np.zeros((0, 9 + HASHED), np.float32)
    length = pc.utf8_length(v).to_numpy(zero_copy_only=False).astype(np.float32)
    share = lambda pattern: pc.count_substring_regex(v, pattern=pattern).to_numpy(zero_copy_only=False) / np.maximum(length, 1)
    flag = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float32)
    lower = pc.utf8_lower(v)
    base = np.column_stack([
        length / 8, share(r"\p{L}"), share("[0-9]"), share("[#*$%&|<>]"), share("[.,;:!?]"),
        flag(pc.match_substring_regex(v, r"^\p{Lu}")), flag(pc.match_substring_regex(v, r"^\p{Lu}{2,}$")),
        flag(pc.match_substring_regex(v, "@|://|www")), flag(pc.is_in(lower, value_set=pa.array(FUNCTION_WORDS)))])
    import pandas as pd
    h = pd.util.hash_array(np.asarray(lower.to_pylist(), dtype=object), hash_key="cuefind-mil-word", categorize=False)
    hashed = np.zeros((len(v), HASHED), np.float32)
    hashed[np.arange(len(v)), (h % HASHED).astype(np.int64)] = np.where(h >> np.uint64(63), 1.0, -1.0)
    return np.column_stack([base, hashed]).astype(np.float32)


FEATURES = 9 + HASHED + 4


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts (at least one each), and where each text's begin."""
    words = split_words(texts)
    n = words.counts
    many = np.maximum((n + PASSAGE - 1) // PASSAGE, 1)
    start = np.concatenate([[0], np.cumsum(many)])
    nth = np.arange(start[-1]) - np.repeat(start[:-1], many)
    first = np.repeat(words.start[:-1], many) + nth * PASSAGE
    size = np.minimum(np.repeat(n, many) - nth * PASSAGE, PASSAGE)
    out = np.zeros((start[-1], FEATURES), np.float32)
    full = np.flatnonzero(size > 0)
    out[:, -1] = size == 0
    if len(full):
        per = np.maximum(size[full, None], 1)
        own = np.column_stack([_word_features(words)[words.codes], repeated_words(words)]).astype(np.float32)
        out[full, :own.shape[1]] = np.add.reduceat(own, first[full], axis=0) / per       # passages cover all words
        passage = np.repeat(full, size[full])
        distinct = np.unique(passage * np.int64(len(words.vocab) + 1) + words.codes) // (len(words.vocab) + 1)
        out[:, -3] = np.bincount(distinct, minlength=len(out)) / np.maximum(size, 1)
    out[:, -2] = np.log1p(size) / np.log1p(PASSAGE)
    return out, start


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] | None       # None: the constant ``share``
    share: float

    def scores(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        if self.p is None:
            return np.full(len(start) - 1, self.share)
        z = _forward(self.p, (x - self.mean) / self.scale, start)["z"]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["W"] + p["b"])
    tan, sig = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -50, 50)))
    e = (tan * sig) @ p["w"]
    size, first = np.diff(start), start[:-1]
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
    a /= np.repeat(np.add.reduceat(a, first), size)
    bag = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"h": h, "tan": tan, "sig": sig, "a": a, "bag": bag, "z": bag @ p["c"] + p["d"][0]}


def _gradient(p, x, start, y) -> dict[str, np.ndarray]:
    f, size = _forward(p, x, start), np.diff(start)
    h, tan, sig, a = f["h"], f["tan"], f["sig"], f["a"]
    dz = (1 / (1 + np.exp(-np.clip(f["z"], -50, 50))) - y) / len(y)
    dbag = np.repeat(dz, size)[:, None] * p["c"]
    da = (dbag * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, start[:-1]), size))
    dgate = de[:, None] * p["w"]
    dtan, dsig = dgate * sig * (1 - tan ** 2), dgate * tan * sig * (1 - sig)
    dh = (a[:, None] * dbag + dtan @ p["V"].T + dsig @ p["U"].T) * (1 - h ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dtan, "U": h.T @ dsig, "w": (tan * sig).T @ de,
            "c": f["bag"].T @ dz, "d": np.array([dz.sum()])}


def train(x: np.ndarray, start: np.ndarray, y: np.ndarray) -> Model:
    """Adam on all sampled bags at once."""
    good = float((y > 0.5).sum())
    share = (good + 1) / (len(y) + 2)
    if not len(y) or good in (0, len(y)):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, share)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - mean) / scale
    rng = np.random.default_rng(_SEED)
    shape = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rng.normal(size=s) * (0 if len(s) == 1 and k in "bd" else 1 / np.sqrt(s[0])) for k, s in shape.items()}
    m, v = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    for t in range(1, EPOCHS + 1):
        for k, g in _gradient(p, x, start, y).items():
            g = g + _DECAY * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - _RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return Model(mean, scale, p, share)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", documents: int = TRAIN_DOCUMENTS, total: int = TRAIN_TOTAL) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    chosen = (labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("_label"))
              .where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out(F.col("_id")))
              .groupBy("_id").agg(F.avg("_label").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(documents))
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
            .join(F.broadcast(chosen), "_id")                           # at most ``documents`` ids
            .groupBy("_id", "_label").agg(F.min("_text").alias("_text")))

    def kernel(batches):
        for rb in text_slices(batches, "_text", SLICE_BYTES):
            x, start = passages(rb.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [rb.column("_id"), rb.column("_label"), pa.array(np.diff(start)),
                 pa.array([x[a:b].tobytes() for a, b in zip(start[:-1], start[1:])], pa.binary())],
                ["id", "label", "passages", "x"])

    bagged = materialise(in_arrow(rows, kernel, "id long, label double, passages long, x binary"), "mil-bags")
    sizes = bagged.select("id", "passages", F.xxhash64("id").alias("h")).collect()
    sizes.sort(key=lambda r: (r["h"], r["id"]))
    fit_in = int(np.searchsorted(np.cumsum([r["passages"] for r in sizes]), total, "right")) if sizes else 0
    taken = [r["id"] for r in sizes[:max(fit_in, 1)]]
    found = sorted(bagged.where(F.col("id").isin(taken)).drop("passages").collect() if len(taken) < len(sizes)
                   else bagged.drop("passages").collect(), key=lambda r: r["id"])
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in found]
    y = np.array([float(r["label"] >= 0.5) for r in found])
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, FEATURES))
    return train(x, np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64), y)


def rows(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batches):
        for rb in text_slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(model.scores(*passages(rb.column("text"))))],
                                             ["doc_id", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return (in_arrow(source, kernel, f"doc_id {kind}, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def accept(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents that the model predicts to be good, with all their columns."""
    def kernel(batches):
        for rb in text_slices(batches, text_col, SLICE_BYTES):
            yield rb.filter(pa.array(model.scores(*passages(rb.column(text_col))) >= 0.5))

    return in_arrow(docs, kernel, docs.schema)
