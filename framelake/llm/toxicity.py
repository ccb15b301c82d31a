"""Toxicity by a counterfactually regularised linear classifier.

A text is the set of its words and word beginnings, hashed.  Logistic regression
is fitted on labelled texts; where one names a group of people, its twin with the
name swapped for another group's must get the same score: the squared change of
the logit is part of the loss.  So naming a group does not raise a score.

Fitting uses a bounded sample (LEARN_ROWS labelled rows, the least hashes of
doc_id); scoring covers every row and whole texts.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the classifier is fitted on, at most: the bound of the sample.
LEARN_ROWS = 12_000
FEATURE_BITS = 20
#: Bytes of a word's beginning that are features beside the word (the first entry, 0).
BEGINNINGS = (0, 4, 5, 6, 7, 8)
LEAST_DOCUMENTS = 4
MOST_FEATURES = 4000
#: Standard deviations of the log ratio of rates that a feature needs.
LEAST_STRENGTH = 2.5
RIDGE = 2e-5
FAIRNESS = 1.0
STEPS = 300
THRESHOLD = 0.3

#: Names of groups by kind; a name is swapped for the next of its kind.
GROUPS = {
    "gender": "women men woman man girls boys female male frauen männer mujeres hombres femmes hommes transgender nonbinary",
    "faith": "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist muslime christen juden musulmanes cristianos judíos musulmans chrétiens juifs",
    "origin": "immigrants refugees foreigners natives africans asians europeans latinos arabs mexicans black white asian african arab latino flüchtlinge ausländer inmigrantes refugiados immigrés réfugiés",
    "orientation": "gay lesbian bisexual straight queer heterosexual homosexual",
    "ability": "disabled deaf blind autistic",
    "age": "elderly young old teenagers",
}

_OTHERS = bytes.maketrans((string.punctuation + string.digits).encode(), b" " * len(string.punctuation + string.digits))


def plain(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_OTHERS) if text else b""


def features(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature), ascending by text."""
    doc, feature = [], []
    for k in BEGINNINGS:
        long = np.flatnonzero(words.end - words.start > k)
        end = words.end[long] if not k else words.start[long] + k
        hashes = common.span_hashes(words.buf, words.start[long], end, 60 + k)
        doc.append(words.doc[long])
        feature.append((hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    key = np.unique(np.concatenate(doc) << FEATURE_BITS | np.concatenate(feature))
    return key >> FEATURE_BITS, key & ((1 << FEATURE_BITS) - 1)


def swaps() -> dict[bytes, bytes]:
    out = {}
    for names in GROUPS.values():
        names = [x.encode() for x in names.split()]
        out.update(zip(names, names[1:] + names[:1]))
    return out


def twin(text: bytes, other: dict[bytes, bytes]) -> bytes | None:
    """The text with names of groups swapped, or None if it has none."""
    words = text.split()
    if not any(w in other for w in words):
        return None
    return b" ".join([other.get(w, w) for w in words])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = LEARN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows outside the held-out quarter.

    The ids with the least hashes are taken, first from labels alone, so no text of
    the other rows moves.  Rows without a label, an id or a text are left out.
    """
    usable = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~common.held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL").select("text", "toxic")


def collect_features(rows: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray | None], np.ndarray]:
    """Features of each text, of its twin if it has one, and the labels; at most LEARN_ROWS texts."""

    def run(batches):
        other = swaps()
        for batch in batches:
            texts = [plain(t) for t in batch.column("text").to_pylist()]
            twins = [twin(t, other) for t in texts]
            both = []
            for some in (texts, [t or b"" for t in twins]):
                doc, feature = features(common.Words(some))
                cut = np.searchsorted(doc, np.arange(len(some) + 1))
                both.append([feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])])
            swapped = [None if t is None else x for t, x in zip(twins, both[1])]
            yield pa.RecordBatch.from_arrays([pa.array(both[0], pa.binary()), pa.array(swapped, pa.binary()), batch.column("toxic").cast(pa.int32())], names=["x", "twin", "y"])

    found = sorted(common.arrow_map(rows, run, "x binary, twin binary, y int").collect(), key=lambda r: (r["x"], r["y"]))
    read = lambda b: None if b is None else np.frombuffer(b, dtype=np.int32)
    return [read(r["x"]) for r in found], [read(r["twin"]) for r in found], np.array([r["y"] for r in found], dtype=float)


class Sparse:
    """A 0/1 matrix of rows by columns, by its ones."""

    def __init__(self, rows: list[np.ndarray], column_of: np.ndarray, columns: int):
        lengths = [len(r) for r in rows]
        column = column_of[np.concatenate(rows)] if sum(lengths) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), lengths)
        used = column >= 0
        self.row, self.column, self.shape = row[used], column[used], (len(rows), columns)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.shape[0])

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=v[self.row], minlength=self.shape[1])


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        words = common.Words(texts)
        logit = np.full(len(texts), self.bias)
        if len(words):
            keys = []
            for k in BEGINNINGS:
                long = np.flatnonzero(words.end - words.start > k)
                end = words.end[long] if not k else words.start[long] + k
                feature = (common.span_hashes(words.buf, words.start[long], end, 60 + k) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
                used = self.weights[feature] != 0
                keys.append(words.doc[long][used] << FEATURE_BITS | feature[used])
            key = np.unique(np.concatenate(keys))
            logit += np.bincount(key >> FEATURE_BITS, weights=self.weights[key & ((1 << FEATURE_BITS) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(x: list[np.ndarray], twins: list[np.ndarray | None], y: np.ndarray) -> Model:
    """Logistic regression with a ridge and the penalty on swapped names, by Adam over all rows."""
    size = 1 << FEATURE_BITS
    weights = np.zeros(size, dtype=np.float32)
    positives = float(y.sum())
    if not len(y) or positives in (0.0, float(len(y))):
        share = (positives + 0.5) / (len(y) + 1) if len(y) else 0.0
        return Model(weights, float(np.log(share / (1 - share))) if share else -30.0)
    held = np.zeros(size)
    toxic = np.zeros(size)
    for row, label in zip(x, y):
        held[row] += 1
        toxic[row] += label
    rate = (toxic + 0.5) / (positives + 1), (held - toxic + 0.5) / (len(y) - positives + 1)
    spread = np.sqrt(1 / (toxic + 0.5) + 1 / (held - toxic + 0.5))
    strength = np.where(held >= LEAST_DOCUMENTS, np.abs(np.log(rate[0] / rate[1])) / spread, 0)
    chosen = np.argsort(-strength, kind="stable")[:MOST_FEATURES]
    chosen = chosen[strength[chosen] > LEAST_STRENGTH]
    column_of = np.full(size, -1)
    column_of[chosen] = np.arange(len(chosen))
    a = Sparse(x, column_of, len(chosen))
    pairs = [k for k, t in enumerate(twins) if t is not None]
    one, other = (Sparse([rows[k] for k in pairs], column_of, len(chosen)) for rows in (x, twins))

    w, b, n = np.zeros(len(chosen)), np.log(positives / (len(y) - positives)), len(y)
    moment, power = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(a.times(w) + b, -30, 30)))
        gradient = a.transposed_times(p - y) / n + RIDGE * w
        if pairs:
            change = one.times(w) - other.times(w)
            gradient += FAIRNESS * 2 * (one.transposed_times(change) - other.transposed_times(change)) / len(pairs)
        g = np.append(gradient, (p - y).mean())
        moment = 0.9 * moment + 0.1 * g
        power = 0.99 * power + 0.01 * g * g
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[chosen] = np.where(np.abs(w) > 1e-3, w, 0)
    return Model(weights, float(b))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*collect_features(training_rows(docs, labels)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs`` (doc_id, text).

    A null or empty text has no features: its score is the base rate's.  Rows are
    independent; an empty table stays empty.  Without labels, or with one kind only,
    the score is the share of toxic labels, or 0.  A long text is scored whole, in
    memory of its size.  Null or repeated ids and further columns change nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [plain(t) for t in batch.column("text").to_pylist()]
            parts = [shared.value.scores(texts[i:j]) for i, j in common.blocks(texts)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, score double, predicted int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", common.held_out().alias("held_out"), "score", "predicted")
