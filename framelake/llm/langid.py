"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point.  A
trigram is the product (binding) of its letters' vectors, rotated (permuted) by
2, 1 and 0 places; a text is the sum (bundle) of its trigrams, a language the sum
of its texts.  A text gets the language with the highest cosine.

Prototypes are sums, so partial sums of partitions merge: each batch adds one
vector per language, and the driver receives languages x dimension numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSION = 512
#: Texts below this cosine to every prototype look like no learned language.
LEAST_COSINE = 0.35
UNKNOWN = "und"
_SMALL = 0x3000
_EDGE = 32

_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or 32 for what is no letter; below 0x3000."""
    if not _FOLD:
        fold = np.full(_SMALL, _EDGE, dtype=np.int64)
        for c in range(_SMALL):
            if chr(c).isalpha():
                low = chr(c).lower()
                fold[c] = ord(low) if len(low) == 1 and ord(low) < _SMALL else c
        _FOLD.append(fold)
    return _FOLD[0]


def folded(text: str) -> np.ndarray:
    """Lower-case letters; runs of other characters become one edge mark; marks at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    fold = _fold_table()
    low = np.where(points < _SMALL, fold[np.minimum(points, _SMALL - 1)], points)
    far = np.flatnonzero(points >= _SMALL)
    if len(far):
        kinds, back = np.unique(points[far], return_inverse=True)
        low[far] = np.array([c if chr(c).isalpha() else _EDGE for c in kinds.tolist()])[back]
    low = np.concatenate(([_EDGE], low, [_EDGE]))
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != _EDGE) | (low[:-1] != _EDGE)
    return low[keep]


def letter_vectors(points: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """One row of +1 and -1 for each code point, the same on every machine."""
    words = common.mix64(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + common.random_words(-(-dimension // 64), 77)[None, :])
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)[:, :dimension]
    return bits.astype(np.float32) * 2 - 1


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, trigram) with counts; a trigram is three 21-bit code points."""
    docs, grams, counts = [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        low = folded(text)
        if len(low) < 3:
            continue
        codes = low[:-2] << 42 | low[1:-1] << 21 | low[2:]
        gram, count = np.unique(codes, return_counts=True)
        docs.append(np.full(len(gram), i))
        grams.append(gram)
        counts.append(count)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(grams), np.concatenate(counts)


def gram_vectors(grams: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    mask = (1 << 21) - 1
    letters, back = np.unique(np.concatenate((grams >> 42, grams >> 21 & mask, grams & mask)), return_inverse=True)
    vectors = letter_vectors(letters, dimension)
    a, b, c = np.split(back, 3)
    return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]


def bundles(rows: int, doc: np.ndarray, gram: np.ndarray, count: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """rows x dimension sums of trigram vectors, in blocks of texts and of trigrams."""
    out = np.zeros((rows, dimension), dtype=np.float32)
    if not len(doc):
        return out
    distinct, back = np.unique(gram, return_inverse=True)
    for lo in range(0, len(distinct), 4096):
        vectors = gram_vectors(distinct[lo : lo + 4096], dimension)
        here = np.flatnonzero((back >= lo) & (back < lo + len(vectors)))
        for top in range(0, rows, 256):
            at = here[(doc[here] >= top) & (doc[here] < top + 256)]
            if len(at):
                dense = np.zeros((min(256, rows - top), len(vectors)), dtype=np.float32)
                dense[doc[at] - top, back[at] - lo] = count[at]
                out[top : top + 256] += dense @ vectors
    return out


def learn(labelled: DataFrame, dimension: int = DIMENSION) -> tuple[list[str], np.ndarray]:
    """Prototypes from (text, lang): every row with a lang and a letter counts, none is sampled."""

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            doc, gram, count = trigrams(batch.column("text").to_pylist())
            if not len(doc):
                continue
            index = {name: k for k, name in enumerate(names)}
            lang_of = np.array([index[x] for x in langs])[doc]
            sums = bundles_of_pairs(len(names), lang_of, gram, count, dimension)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums.astype(np.float64).tolist(), pa.list_(pa.float64()))], names=["lang", "part"])

    parts = common.arrow_map(labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang"), run, "lang string, part array<double>")
    # One row per language and dimension reaches the driver; sums of whole numbers below 2**53 are exact in any order.
    rows = parts.select("lang", F.posexplode("part").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r["lang"] for r in rows})
    out = np.zeros((len(langs), dimension))
    for r in rows:
        out[langs.index(r["lang"]), r["at"]] = r["x"]
    return langs, out


def bundles_of_pairs(rows: int, row: np.ndarray, gram: np.ndarray, count: np.ndarray, dimension: int) -> np.ndarray:
    """As bundles(), after adding up the counts of equal (row, trigram)."""
    distinct, back = np.unique(gram, return_inverse=True)
    table = np.zeros((rows, len(distinct)), dtype=np.float64)
    np.add.at(table, (row, back), count)
    out = np.zeros((rows, dimension))
    for lo in range(0, len(distinct), 4096):
        out += table[:, lo : lo + 4096] @ gram_vectors(distinct[lo : lo + 4096], dimension).astype(np.float64)
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text).

    score is the best cosine, cut to [0, 1].  A null text, one without a letter,
    and any text when nothing was learned get ``und`` and 0.  Ties go to the
    language that sorts first.  Rows are independent: repeated rows and null ids
    change nothing, and an empty table stays empty.  A long text is read whole, in
    memory of some 30 bytes a letter.  Other columns are not read.
    """
    langs, sums = model
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    prototypes = (sums / np.where(norms > 0, norms, 1)).astype(np.float32)
    dimension = sums.shape[1] if len(langs) else DIMENSION

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            doc, gram, count = trigrams(batch.column("text").to_pylist())
            best, score, seen = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, dtype=bool)
            seen[doc] = True
            if len(langs) and len(doc):
                vectors = bundles(n, doc, gram, count, dimension)
                cosine = vectors @ prototypes.T
                length = np.linalg.norm(vectors, axis=1)
                cosine = cosine / np.where(length > 0, length, 1)[:, None]
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(n), best].astype(np.float64), 0, 1)
            known = seen & bool(langs)
            names = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double")


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~common.held_out() & F.col("lang").isNotNull())


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = predict(docs, learn(learning_rows(docs)))
    return out.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` in a learned language, with their columns unchanged.

    Goes: a null text, a text without a letter, and a text whose best cosine is
    below LEAST_COSINE although it has at least 60 letters' worth of trigrams.
    """
    model = learn(learning_rows(docs))
    langs, sums = model
    if not langs:
        return docs.filter(F.lit(False))
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    prototypes = (sums / np.where(norms > 0, norms, 1)).astype(np.float32)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            doc, gram, count = trigrams(batch.column("text").to_pylist())
            keep = np.zeros(n, dtype=bool)
            if len(doc):
                vectors = bundles(n, doc, gram, count)
                length = np.linalg.norm(vectors, axis=1)
                best = (vectors @ prototypes.T).max(axis=1) / np.where(length > 0, length, 1)
                total = np.bincount(doc, weights=count, minlength=n)
                keep = (total > 0) & ((best >= LEAST_COSINE) | (total < 60))
            yield batch.filter(pa.array(keep))

    return common.arrow_map(docs, run, docs.schema)
