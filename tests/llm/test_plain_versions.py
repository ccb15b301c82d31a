"""Sharding and language ID against plain versions; the pipeline on awkward and empty tables with names that clash."""

import hashlib
import heapq
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_text_operators import AWKWARD

from framelake.llm import common, langid, sharding

#: Names that the operators use inside or add.
CLASHES = "numbers n_removed kept score ids decoded h tkey spans cell part blob group item shard slot component_id lang_pred held_out n_words runs rank".split()


def clashing(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *(f"own {c}" for c in CLASHES)) for i, t, lang in rows], schema)


# --- op7 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [20, 40])
def test_shards_equal_a_plain_heap(spark, shards):
    """With few bytes every group of equal texts is an item of its own."""
    rng = np.random.default_rng(shards)
    texts = ["", None, *("x" * int(n) for n in rng.integers(1, 500, 30)), *(f"{k} é" for k in range(30))]
    rows = [(int(k), texts[int(t)], "en") for k, t in enumerate(rng.integers(0, len(texts), 150))] + [(5, "x", "en"), (None, "x", "en")]
    size = defaultdict(int)
    for _, t, _ in rows:
        size[(t or "").encode()] += len((t or "").encode()) + 16
    assert sum(size.values()) // (shards * sharding.LARGE) <= min(size.values())
    heap, want = [(0, s) for s in range(shards)], {}
    for text in sorted(size, key=lambda t: (-size[t], hashlib.md5(t).hexdigest())):
        load, shard = heapq.heappop(heap)
        want[text] = shard
        heapq.heappush(heap, (load + size[text], shard))
    by_crc = {(zlib.crc32(t), len(t) + 16): s for t, s in want.items()}
    got = sharding.assign(clashing(spark, rows), shards).collect()
    assert len(got) == len(rows)
    assert all(r["shard"] == by_crc[r["text_crc32"], r["size"]] for r in got)


# --- op9 ----------------------------------------------------------------------------------------


def plain_letters(text):
    """Lower-case letters; one mark for each run of others, and at both ends."""
    out = [32]
    for c in text:
        if c.isalpha():
            low = c.lower()
            out.append(ord(low) if len(low) == 1 and (ord(low) < 0x3000) == (ord(c) < 0x3000) else ord(c))
        elif out[-1] != 32:
            out.append(32)
    return out if out[-1] == 32 else [*out, 32]


def plain_bundle(text):
    letters, total = plain_letters(text or ""), np.zeros(langid.DIMENSION)
    vector = {c: langid.letter_vectors(np.array([c]))[0] for c in set(letters)}
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        total += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
    return total


def test_language_id_equals_plain_bundles(spark):
    texts = {"en": "the cat sat on the mat and the other hat", "de": "der hund und die katze sind nicht über dem haus", "fr": "le chat est sur la table où été"}
    rows = [(10 * k + n, f"{t} {t[n:]} {n}", lang) for k, (lang, t) in enumerate(texts.items()) for n in range(6)]
    rows += [(90, "the hat on the cat", None), (91, "über die katzen", None), (92, "42 !", None), (93, "", None), (94, None, None), (95, "ÀÉ " * 50, None), (96, "漢字 漢字", None), (97, "A", None), (90, "la table", None)]
    docs = clashing(spark, rows)
    learned = langid.learning_rows(docs)
    prototypes = defaultdict(lambda: np.zeros(langid.DIMENSION))
    for r in learned.collect():
        prototypes[r["lang"]] += plain_bundle(r["text"])
    langs = sorted(prototypes)
    want = []
    for i, t, _ in rows:
        v = plain_bundle(t)
        if not t or not any(c.isalpha() for c in t):
            want.append((i, "und", 0.0))
            continue
        cosine = [v @ prototypes[x] / (np.linalg.norm(v) * np.linalg.norm(prototypes[x])) for x in langs]
        want.append((i, langs[int(np.argmax(cosine))], round(float(np.clip(max(cosine), 0, 1)), 4)))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in langid.predict(docs, langid.learn(learned)).collect()]
    key = lambda x: (x[0], x[1], round(x[2], 3))
    assert sorted(map(key, got)) == sorted(map(key, want))


# --- pipeline -----------------------------------------------------------------------------------


@pytest.fixture
def tables(spark, sf, tmp_path):
    def write(rows):
        clashing(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
        common.table(spark, sf, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_pipeline_keeps_columns_that_clash(spark, tables):
    import corpus_pipeline

    where = tables(AWKWARD)
    docs = common.table(spark, where, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.checkpointed(stage(spark, docs, where))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES], name
        assert all(r[c] == f"own {c}" for r in docs.collect() for c in CLASHES), name
    rows = docs.select("doc_id", "text").collect()
    assert rows and all(r["text"] for r in rows)
    out = corpus_pipeline.run(spark, where).collect()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in out) == sorted((str(r["doc_id"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows)


def test_pipeline_of_nothing(spark, tables):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, tables([]))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
