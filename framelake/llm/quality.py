"""Quality rules: counts, repeated windows, and divergence from language references.

A document's histogram of character classes and of common words is compared with
that of each language by Jensen-Shannon distance (base 2, so 0 to 1); the nearest
language counts.  Short documents are not judged by a histogram that they are too
short to fill.  References are sums over all documents with a language, merged by
Spark; only (languages x bins) numbers reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
COMMON_WORDS = 100
#: A histogram is judged from so many characters or words on.
GUARD_CHARS = 200
GUARD_WORDS = 50
#: Greatest distances of a kept document; a document of n words may be FEW / sqrt(n) further away.
MAX_CHAR_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.45
FEW = 1.0

CLASSES = ["lower", "upper", "digit", "space", "stop", "punct", "symbol", "other"]
SYMBOLS = b"#*$%&|<>"
_SMALL = 0x3000
_CLASS: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _CLASS:
        table = np.full(_SMALL + 1, 7, dtype=np.int8)
        for c in range(_SMALL):
            x = chr(c)
            if x.isupper() or x.istitle():
                table[c] = 1
            elif x.isalpha():
                table[c] = 0
            elif x.isdigit():
                table[c] = 2
            elif x.isspace():
                table[c] = 3
            elif x in ".,":
                table[c] = 4
            elif c < 128 and c > 32:
                table[c] = 5
        table[list(SYMBOLS)] = 6
        table[_SMALL] = 0  # scripts beyond are counted as letters
        _CLASS.append(table)
    return _CLASS[0]


def char_histograms(texts: list[bytes]) -> np.ndarray:
    """len(texts) x classes counts of code points."""
    table = _class_table()
    out = np.zeros((len(texts), len(CLASSES)))
    points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4") for t in texts]
    lengths = np.array([len(p) for p in points])
    if not lengths.sum():
        return out
    doc = np.repeat(np.arange(len(texts)), lengths)
    kind = table[np.minimum(np.concatenate(points), _SMALL)]
    return np.bincount(doc * len(CLASSES) + kind, minlength=out.size).reshape(out.shape).astype(float)


def repeated_words(words: common.Words, hashes: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text: words in a window of ``width`` words that the text holds twice or more."""
    at = common.runs_in_docs(words, width)
    if not len(at):
        return np.zeros(words.n_docs, dtype=np.int64)
    key = common.mix64(common.window_hashes(hashes, width)[at] + words.doc[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    hit = at[twice]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=words.n_docs)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = common.Words(texts)
    hashes = words.hashes()
    lead = np.cumsum(np.concatenate(([0], ((words.buf & 0xC0) != 0x80).astype(np.int64))))
    in_word = lead[words.end] - lead[words.start]
    symbol = np.cumsum(np.concatenate(([0], np.isin(words.buf, np.frombuffer(SYMBOLS, np.uint8)).astype(np.int64))))
    return {
        "words": words,
        "n_words": words.counts,
        "word_chars": np.bincount(words.doc, weights=in_word, minlength=words.n_docs).astype(np.int64),
        "n_symbols": symbol[words.text_end] - symbol[words.text_start] if words.n_docs else words.counts,
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": repeated_words(words, hashes),
    }


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of p (rows x bins) to each row of q (languages x bins), counts or shares; 0 to 1."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
    out = np.zeros((len(p), len(q)))
    for k in range(len(q)):
        mid = (p + q[k]) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(p > 0, p * np.log2(p / mid), 0).sum(axis=1)
            b = np.where(q[k] > 0, q[k] * np.log2(q[k] / mid), 0).sum(axis=1)
        out[:, k] = np.sqrt(np.clip((a + b) / 2, 0, 1))
    return out


class References:
    """Per language: character-class shares, and shares of its common words with all the rest as the last bin."""

    def __init__(self, chars: dict[str, np.ndarray], words: dict[str, list[tuple[int, int]]], totals: dict[str, int]):
        self.langs = sorted(chars)
        self.chars = np.array([chars[x] for x in self.langs]) if self.langs else np.zeros((0, len(CLASSES)))
        self.keys, self.shares = [], []
        for x in self.langs:
            top = sorted(words.get(x, []))
            self.keys.append(np.array([k for k, _ in top], dtype=np.int64))
            counts = [c for _, c in top]
            self.shares.append(np.array([*counts, max(0, totals.get(x, 0) - sum(counts))], dtype=float))

    def distances(self, texts: list[bytes], lowered: common.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars = jensen_shannon(char_histograms(texts), self.chars).min(axis=1)
        words = np.ones((len(texts), len(self.langs)))
        value = common.signed(hashes)
        for k, (keys, shares) in enumerate(zip(self.keys, self.shares)):
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            bin_of = np.where(keys[at] == value, at, len(keys))
            flat = np.bincount(lowered.doc * len(shares) + bin_of, minlength=len(texts) * len(shares))
            words[:, k] = jensen_shannon(flat.reshape(len(texts), -1).astype(float), shares[None, :])[:, 0]
        return chars, words.min(axis=1)


def learn(docs: DataFrame, common_words: int = COMMON_WORDS) -> References:
    """References from all rows of ``docs`` (text, lang) that have a language."""
    width = len(CLASSES)

    def run(batches):
        for batch in batches:
            texts, langs = common.raw_texts(batch.column("text")), batch.column("lang").to_pylist()
            names = sorted(set(langs))
            lang_of = np.array([names.index(x) for x in langs])
            sums = np.zeros((len(names), width))
            np.add.at(sums, lang_of, char_histograms(texts))
            keys, owner, counts = [], [], []
            for i, j in common.blocks(texts, 8 * common.BLOCK_BYTES):
                words = common.Words(texts[i:j], lower=True)
                if not len(words):
                    continue
                value, of = words.hashes(), lang_of[i:j][words.doc]
                for k in range(len(names)):
                    key, count = np.unique(value[of == k], return_counts=True)
                    keys.append(common.signed(key))
                    owner.append(np.full(len(key), k))
                    counts.append(count)
            nothing = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[k] for k in [*np.repeat(np.arange(len(names)), width), *np.concatenate([nothing, *owner])]], pa.string()),
                    pa.array(np.concatenate([np.tile(np.arange(width), len(names)), *keys]).astype(np.int64)),
                    pa.array(np.concatenate([np.zeros(len(names) * width, bool), *[np.ones(len(x), bool) for x in keys]])),
                    pa.array(np.concatenate([sums.ravel().astype(np.int64), *counts]).astype(np.int64)),
                ],
                names=["lang", "key", "is_word", "n"],
            )

    rows = common.arrow_map(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang"), run, "lang string, key bigint, is_word boolean, n bigint")
    counts = rows.groupBy("lang", "is_word", "key").agg(F.sum("n").alias("n"))
    # Two steps keep the ranking of a large language out of one task: best of each part first, then best of those.
    within = lambda *by: Window.partitionBy("lang", "is_word", *by).orderBy(F.desc("n"), "key")
    parted = counts.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64)))
    parted = parted.withColumn("all", F.sum("n").over(Window.partitionBy("lang", "is_word", "part")))
    best = parted.withColumn("r", F.row_number().over(within("part"))).filter(F.col("r") <= common_words)
    totals, chars, words = {}, {}, {}
    for r in best.collect():  # at most languages x (64 x common_words + classes) rows
        if r["is_word"]:
            words.setdefault(r["lang"], []).append((r["n"], r["key"]))
            totals.setdefault(r["lang"], {})[r["part"]] = r["all"]
        else:
            chars.setdefault(r["lang"], np.zeros(width))[r["key"]] = r["n"]
    top = {x: [(k, n) for n, k in sorted(v, key=lambda y: (-y[0], y[1]))[:common_words]] for x, v in words.items()}
    return References(chars, top, {x: sum(v.values()) for x, v in totals.items()})


def judge(docs: DataFrame, references: References, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Measures and verdict for every row of ``docs`` (doc_id, text).

    A null or empty text has no words: every count is 0 and base_failed is true.
    Without references only the base rules hold.  char_distance and word_distance
    are null where the document is too short to be judged.  Rows are independent, so
    null or repeated ids and repeated rows change nothing; an empty table stays empty.
    A long text is measured whole, in memory of its size.  Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts = common.raw_texts(batch.column("text"))
            parts = []
            for i, j in common.blocks(texts, 2 * common.BLOCK_BYTES):
                m = measures(texts[i:j])
                n = m["n_words"]
                chars = words = np.zeros(j - i)
                if references.langs:
                    lowered = common.Words(texts[i:j], lower=True)
                    chars, words = references.distances(texts[i:j], lowered, lowered.hashes())
                slack = FEW / np.sqrt(np.maximum(n, 1))
                judge_chars = bool(references.langs) & (m["word_chars"] >= GUARD_CHARS)
                judge_words = bool(references.langs) & (n >= GUARD_WORDS)
                failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
                odd = (judge_chars & (chars > max_char + slack)) | (judge_words & (words > max_word + slack))
                parts.append((n, m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], failed, ~failed & ~odd, chars, ~judge_chars, words, ~judge_words))
            if not parts:
                continue
            x = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in x[:5]], pa.array(x[5].astype(bool)), pa.array(x[6].astype(bool)), pa.array(x[7], mask=x[8]), pa.array(x[9], mask=x[10])],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"],
            )

    return common.arrow_map(
        docs.select("doc_id", "text"), run,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double",
    )


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return judge(docs, learn(docs))
