"""Each text operator against a brute-force version, on awkward rows and on the small table."""

import base64
import hashlib
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from framelake.llm import bpe, common, decontaminate, html, html_training, langid, lines, neardup, quality, sharding, substrings, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, group string, size int, shard int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "g", 1, 2) for i, t, lang in rows], SCHEMA)


LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(70))


def thue_morse(n):
    """Two words of 2**n letters that no sum of powers tells apart, whatever the base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


ALIKE, UNLIKE = thue_morse(10)
AWKWARD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n\x0b ", None),
    (4, "one", "en"),
    (5, f"alpha beta gamma\n{PASSAGE} end", "en"),
    (6, f"other start words {PASSAGE}\x0btail piece", "de"),
    (7, f"alpha beta gamma\n{PASSAGE} end", "en"),
    (7, f"alpha beta gamma\n{PASSAGE} end", "en"),
    (None, f"alpha beta gamma\n{PASSAGE} end", "en"),
    (8, LONG, "fr"),
    (9, LONG + " x", "fr"),
    (10, "漢字 " * 40 + "été Ünï 😀", "zh"),
    (11, "a a a a a a a a a a " * 30, "en"),
    (12, "!!! ... 123 456", "en"),
    (13, "x" * 40_000, "en"),
    (15, " ".join(f"q{k}" for k in range(30)) + f" {ALIKE} " + " ".join(f"r{k}" for k in range(19)), "en"),
    (16, " ".join(f"q{k}" for k in range(30)) + f" {UNLIKE} " + " ".join(f"r{k}" for k in range(19)), "en"),
    (17, f"x {ALIKE}", "en"),
    (18, f"x {UNLIKE}", "en"),
    (19, f"n1 n2 n3 n4 n5 {ALIKE}\nn1 n2 n3 n4 n5 {UNLIKE} n7", "en"),
    (20, " ".join([ALIKE, UNLIKE, "t"] * 9), "en"),
    (21, " ".join(f"s{k} {ALIKE if k % 2 else UNLIKE}" for k in range(40)), "en"),
    (22, " ".join(["c d"[:1], "d"][int(c == "b")] for c in ALIKE) + " " + " ".join("cd"[c == "b"] for c in UNLIKE), "en"),
    (23, " ".join("cd"[c == "b"] for c in UNLIKE) + " end", "en"),
    (14, "line one has words here\nline one has words here\n\nshort\nline one has words there here", "en"),
]


def words(text):
    return (text or "").encode().split()


def small(spark, sf):
    return common.table(spark, sf, "documents")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["awkward", "small", "empty"])
def docs(request, spark, sf):
    if request.param == "small":
        return small(spark, sf)
    return frame(spark, AWKWARD if request.param == "awkward" else [])


# --- op2 ----------------------------------------------------------------------------------------


def test_line_dedup(docs):
    got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(docs).collect())
    rows = pairs_of(docs)
    judged = sorted({(i, k, frozenset(x.lower().split())) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.encode().split(b"\n"))}, key=lambda x: x[:2])
    judged = [x for x in judged if len(x[2]) >= lines.LEAST_WORDS]
    gone, kept, holders, sets = defaultdict(set), set(), defaultdict(list), []
    for i, k, s in judged:
        near = s in kept
        if not near:
            shared = Counter(m for w in s for m in holders[w])
            near = any(100 * n >= 80 * (len(s) + len(sets[m]) - n) for m, n in shared.items())
            kept.add(s)
            for w in s:
                holders[w].append(len(sets))
            sets.append(s)
        if near:
            gone[i].add(k)
    want = Counter()
    for i, t in rows:
        out = None if t is None else b"\n".join(x for k, x in enumerate(t.encode().split(b"\n")) if i is None or k not in gone[i]).decode()
        want[(i, out, len(gone[i]) if i is not None and t is not None else 0)] += 1
    assert got == want


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_line_dedup_of_a_frequent_word(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "MOST_OPEN", most)
    monkeypatch.setattr(lines, "CELL", 3)
    monkeypatch.setattr(lines, "MANY", 2)
    monkeypatch.setattr(lines, "FEW", 1)
    rows = [(i, f"rare{i % 2} b{i} c d e f g h i j k l m", "en") for i in range(12)]
    out = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert out == {i: int(i >= 2) for i in range(12)}


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_lines_that_only_a_late_candidate_matches(spark, monkeypatch, most):
    """Lines whose likeliest candidates fail meet all others, by broadcast or by shuffle."""
    monkeypatch.setattr(lines, "MOST_OPEN", most)
    monkeypatch.setattr(lines, "MANY", 2)
    monkeypatch.setattr(lines, "FEW", 1)
    monkeypatch.setattr(lines, "CELL", 5)
    late, real = [], lines.open_candidates
    monkeypatch.setattr(lines, "open_candidates", lambda *a: late.append(1) or real(*a))
    rng = np.random.default_rng(2)
    base = [f"t{k}" for k in range(150)]
    rows = []
    for i in range(80):
        w = list(base)
        for k in rng.choice(150, rng.integers(8, 24), replace=False):
            w[k] = f"n{i}k{k}"
        rows.append((i, " ".join(w), "en"))
    out = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(frame(spark, rows)).collect()}
    sets = [set(t.split()) for _, t, _ in rows]
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert out == {i: int(any(near(sets[i], sets[j]) for j in range(i))) for i in range(80)}
    assert late


# --- op3 ----------------------------------------------------------------------------------------


def test_quality_counts(docs):
    got = Counter(tuple(r)[:7] for r in quality.judge(docs, quality.learn(docs)).collect())
    want = Counter()
    for i, t in pairs_of(docs):
        t = t or ""
        w = words(t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                dup += x in seen
                seen.add(x)
        count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want[(i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed)] += 1
    assert got == want


def test_jensen_shannon():
    p = np.array([[1.0, 0, 0], [1, 1, 2]])
    q = np.array([[0.0, 1, 1], [1, 1, 2]])
    d = quality.jensen_shannon(p, q)
    assert d[0, 0] == pytest.approx(1) and d[1, 1] == pytest.approx(0, abs=1e-7) and (0 <= d).all() and (d <= 1).all()


def test_quality_keeps_good_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in quality.op3_quality_rules(spark, sf).collect()}
    labels = [r for r in common.table(spark, sf, "labels").collect() if not out[r["doc_id"]]["base_failed"]]
    good = [out[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]
    bad = [out[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.5


# --- op4 ----------------------------------------------------------------------------------------


def plain_repeats(rows, width):
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return want


@pytest.mark.parametrize("width", [50, 6])
def test_substring_dedup(docs, width):
    rows = [(i, " ".join(t.split(" ")[:3000]) if t and width == 6 else t) for i, t in pairs_of(docs)]
    source = docs.sparkSession.createDataFrame(rows, "doc_id bigint, text string")
    out = substrings.remove_repeats(source, width).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out)
    assert got == plain_repeats(rows, width)


REPEATS = [(i, " ".join(f"u{i}x{k}" for k in range(40)) + f" {PASSAGE} " + " ".join(f"v{i}y{k}" for k in range(40))) for i in range(30)]


@pytest.mark.parametrize("what", ["full sketch", "shuffled lists", "small parts"])
def test_repeats_are_found_whatever_the_plan(spark, monkeypatch, what):
    if what == "full sketch":
        monkeypatch.setattr(substrings, "cell_bits", lambda size: 4)
    elif what == "shuffled lists":
        monkeypatch.setattr(substrings, "MOST_BROADCAST", 0)
        monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    else:
        monkeypatch.setattr(substrings, "PART_CELLS", 50)
        monkeypatch.setattr(substrings, "TASK_CELLS", 100)
    out = substrings.remove_repeats(spark.createDataFrame(REPEATS, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {i: 0 if i == 0 else 70 for i in range(30)}


# --- op5 ----------------------------------------------------------------------------------------


def plain_groups(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        if i is not None:
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter()
        for g in sets[i]:
            shared.update(holders[g])
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    out = neardup.near_duplicates(docs, width).collect()
    assert len(out) == docs.count()
    want = plain_groups(pairs_of(docs), width)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])


@pytest.mark.parametrize("most", [11, 16])
def test_near_duplicates_in_small_cells(spark, monkeypatch, most):
    """A group of near copies, not all near the first one, over cells of a few rows, rounds of joins and shuffled lists."""
    monkeypatch.setattr(neardup, "CELL", 4)
    monkeypatch.setattr(neardup, "CELL_SHINGLES", 1000)
    if most == 16:
        monkeypatch.setattr(neardup, "MOST_LINKS", 0)
        monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    reached, exact = [], neardup.exact_links
    monkeypatch.setattr(neardup, "exact_links", lambda *a: reached.append(1) or exact(*a))
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for k in rng.choice(120, rng.integers(1, most), replace=False):
            w[k] = f"n{i}k{k}"
        rows.append((i, " ".join(w)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == plain_groups(rows, 2)
    assert reached or most == 11


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    values = common.mix64(rng.integers(0, 2**62, 3000).astype(np.uint64))
    a, b = np.sort(values[:2000]), np.sort(values[400:2400])
    both = np.unique(np.concatenate((a, b)))
    sketch = [neardup.registers(x, np.array([0, len(x)])) for x in (a, b, both)]
    assert (np.maximum(sketch[0], sketch[1]) == sketch[2]).all()
    estimate = neardup.estimate(sketch[0], sketch[1], np.array([2000]), np.array([2000]))[0]
    assert abs(estimate - 1600 / 2400) < 0.15


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "MOST_LINKS", most)
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(k, k + 1) for k in range(1000, 1040)]
    found = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    assert {x: found.get(x, x) for x in parent} == parent


# --- op6 ----------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, sf).collect()}
    held = [(out[r["doc_id"]]["score"], r["toxic"]) for r in common.table(spark, sf, "labels").collect() if out[r["doc_id"]]["held_out"]]
    high, low = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([h > x for h in high for x in low]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())


def test_counterfactual_pairs_even_out_names():
    """With a biased sample, the penalty takes the weight off the name of a group."""
    rng = np.random.default_rng(0)
    filler = [f"word{k}" for k in range(60)]
    texts, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        name = "muslims" if bad or k % 16 == 1 else "christians" if k % 3 else ""
        texts.append(" ".join([*rng.choice(filler, 8), name, "vile" if bad and k % 8 else ""]).encode())
        labels.append(float(bad))

    def rows(some):
        doc, feature = toxicity.features(common.Words(some))
        cut = np.searchsorted(doc, np.arange(len(some) + 1))
        return [feature[a:b] for a, b in zip(cut[:-1], cut[1:])]

    other = toxicity.swaps()
    twins = [toxicity.twin(t, other) for t in texts]
    fitted = rows([t or b"" for t in twins])
    free = toxicity.fit(rows(texts), [None] * len(texts), np.array(labels))
    fair = toxicity.fit(rows(texts), [x if t else None for t, x in zip(twins, fitted)], np.array(labels))
    neutral = [b"word1 word2 muslims", b"word1 word2 christians"]
    gap = lambda m: abs(np.subtract(*m.scores(neutral)))
    assert gap(fair) < 0.5 * gap(free)
    assert fair.scores([b"word1 vile"])[0] > fair.scores([b"word1 muslims"])[0]


def test_toxicity_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 1, 0), (7, 0, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == len(AWKWARD)
    assert toxicity.score(frame(spark, []), toxicity.learn(docs, labels.limit(0))).count() == 0


# --- op7 ----------------------------------------------------------------------------------------


def test_longest_first():
    assert sharding.longest_first([(7, "a"), (5, "b"), (4, "c"), (3, "d"), (1, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_sharding(docs):
    rows = sharding.assign(docs).collect()
    assert len(rows) == docs.count()
    text = defaultdict(set)
    for i, t in pairs_of(docs):
        text[i].add((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    group, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"]) in text[r["doc_id"]]
        group[(r["size"], r["text_crc32"])].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in group.values())
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < 40 for k, s in slots.items())


def test_shards_are_level(spark):
    load = Counter()
    for r in sharding.assign(common.table(spark, "/root/testdata/sf0.01", "documents")).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 40 and max(load.values()) < 1.02 * min(load.values())


# --- op8 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, reference_encoding):
    got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_decode(docs).collect())
    want = Counter()
    for i, t in pairs_of(docs):
        ids = reference_encoding.encode_ordinary(t or "")
        want[(i, struct.pack(f"<{len(ids)}I", *ids), (t or "").encode())] += 1
    assert got == want


def test_byte_bpe_of_random_pieces(reference_encoding):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = bpe.Vocabulary.from_bytes(f.read(), public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    parts = ["a", "b", "the", "é", " ", "  ", "\n", "1", "漢", "!", "aaaa", "'s", "😀", "ing", "q" * 90]
    for _ in range(300):
        text = "".join(rng.choice(parts, rng.integers(0, 60)))
        ids = reference_encoding.encode_ordinary(text)
        assert vocabulary.encode_batch([text])[0] == struct.pack(f"<{len(ids)}I", *ids)


# --- op9 ----------------------------------------------------------------------------------------


def test_language_id_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in langid.op9_language_id(spark, sf).collect()}
    held = [out[r["doc_id"]]["lang_pred"] == r["lang"] for r in common.table(spark, sf, "documents").collect() if out[r["doc_id"]]["held_out"]]
    assert np.mean(held) > 0.98


def test_language_id_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD)
    out = langid.predict(docs, langid.learn(langid.learning_rows(docs))).collect()
    assert len(out) == len(AWKWARD)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 12)) and 0 <= r["score"] <= 1 for r in out)
    assert langid.predict(docs, langid.learn(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {1, 2, 3, 12}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_bundles_are_sums_of_bound_vectors():
    doc, gram, count = langid.trigrams(["abab", "ba"])
    direct = np.zeros((2, langid.DIMENSION))
    for d, g, n in zip(doc, gram, count):
        v = [langid.letter_vectors(np.array([g >> s & (1 << 21) - 1]))[0] for s in (42, 21, 0)]
        direct[d] += n * np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    assert np.allclose(langid.bundles(2, doc, gram, count), direct)


# --- op10 ---------------------------------------------------------------------------------------


def test_decontamination(spark):
    item = [f"q{k}" for k in range(30)]
    edited = list(item)
    edited[7], edited[19] = "changed", "other"
    moved = [*item[:15], "inserted", "words", *item[15:]]
    docs = frame(
        spark,
        [
            (1, "some text before " + " ".join(item) + " and after", "en"),
            (2, "x " + " ".join(edited) + " y", "en"),
            (3, " ".join(moved).upper() + "!", "en"),
            (4, " ".join(reversed(item)), "en"),
            (5, " ".join(item[:5]) + " clean words that follow", "en"),
            (6, None, "en"),
            (7, "a tiny item here ok", "en"),
            (8, "", "en"),
            (9, " \t", None),
        ],
    )
    benchmark = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short"), (13, "tiny item, here OK a"), (14, "A tiny item here OK.")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, benchmark).collect()}
    assert found == {(1, 10), (2, 10), (3, 10), (7, 14)}
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()}.isdisjoint({1, 2, 3, 7})
    assert clean.count() == docs.count() - 4 and decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0


def test_benchmark_blocks_agree(spark, sf, monkeypatch):
    docs, items = small(spark, sf), common.table(spark, sf, "benchmark")
    whole = sorted(map(tuple, decontaminate.overlaps(docs, items).collect()))
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", (300,))
    assert sorted(map(tuple, decontaminate.overlaps(docs, items).collect())) == whole
    texts = {r["doc_id"]: " ".join(r["text"].split()) for r in docs.collect()}
    exact = {(i, r["item_id"]) for i, t in texts.items() for r in items.collect() if " ".join(r["text"].split()) in t}
    assert exact <= {x[:2] for x in whole}


# --- op1 ----------------------------------------------------------------------------------------


def test_extraction_of_labelled_pages():
    model, wrong, total = html.trained(), 0, 0
    for page in html_training.labelled_pages(60, seed=99):
        found = html.leaf_blocks(page)
        gold = [next((n.gold for n in reversed(html.chain(node)) if n.gold is not None), "0") == "1" for _, node, _ in found]
        got = model.decode(model.emissions(found))
        plain = [sum(model.weights.get(f, 0.0) for f in html.chain_features(node) + html.text_features(text, linked)) for text, node, linked in found]
        assert model.emissions(found) == pytest.approx(plain)
        wrong += sum(bool(a) != bool(b) for a, b in zip(gold, got))
        total += len(found)
    assert wrong < 0.01 * total


def test_extraction(spark, sf):
    pages = [
        (1, "u", '<nav><a href=x>Menu</a></nav><article><h1>T &amp; x</h1><p>One\n  <b>two</b>.<p>Three &eacute;<script>var a="</p>";</script><div class="ad">Buy now, it is good.</div></article><footer>&copy; us</footer>'),
        (2, None, None),
        (3, "u", ""),
        (None, "u", "<main><p>Cut off &am"),
        (4, "u", "plain < text"),
        (5, "u", "<!-- <p>no</p> --><article><p>yes</p></article><section class=comments><p>I liked it a lot, thanks.</p></section>"),
        (5, "u", "<article>" + "<div>" * 500 + "<p>deep</p>"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, text string")
    got = [r["text"] for r in html.extract(df).collect()]
    assert got[0] == "T & x\n\nOne two.\n\nThree é" and got[1] == got[2] == "" and got[3] == "Cut off &am" and got[5] == "yes" and got[6] == "deep"
    assert html.extract(df.limit(0)).count() == 0
    out = html.op1_html_extraction(spark, sf).collect()
    assert len(out) == common.table(spark, sf, "pages").count() and all(r["n_chars"] == len(r["text"]) for r in out)


def test_many_class_names_cost_no_more_with_many_blocks():
    crf = html.Crf({"tag:p": 1.0, "near:div": 0.5, "nearname:c7": 0.25, "nearstem:c299": 0.125, "leaf:p": 0.1, "name:c9": 0.3, "inside:p": 0.7}, np.zeros(2), np.zeros((2, 2)))
    page = f"<article><div class='{' '.join(f'c{k}' for k in range(3000))}'>" + "<p>x</p>" * 20_000 + "</div><p>y</p></article><p>z</p>"
    begin = time.time()
    blocks = html.leaf_blocks(page)
    scores = crf.emissions(blocks)
    assert time.time() - begin < 2
    for at in (0, 19_999, 20_000, 20_001):
        text, node, linked = blocks[at]
        assert scores[at] == pytest.approx(sum(crf.weights.get(f, 0.0) for f in html.chain_features(node) + html.text_features(text, linked)))


@pytest.mark.parametrize("part", ["<div>x", "<b>x<div>y</div>", "<div class=\"a{}\">x", "<li>x<b>", "<i></b>x", "<p><span>x"])
def test_deep_pages(part):
    """50,000 nested tags take seconds, as do end tags without a start."""
    began = time.perf_counter()
    text = html.trained().extract("<article><p>" + "".join(part.format(k) for k in range(50_000)))
    assert isinstance(text, str) and time.perf_counter() - began < 20


HAND_PAGES = [
    ("<body><nav><a href=/>Home</a> <a href=/x>News</a></nav><article><h1>A title of some words</h1><p>One &amp; two are <b>three</b>, he said.</p></article><footer>© 2020 All rights reserved</footer>", "One & two are three, he said."),
    ("<div id=header><ul><li><a href=a>Start</a><li><a href=b>Shop</a></ul></div><main><p>The first paragraph has\n enough words to be read as text.<p>The second one, too, ends with a stop.</main><div class=sidebar><h3>Related</h3><a href=q>More like this</a></div>", "The first paragraph has enough words to be read as text.\n\nThe second one, too, ends with a stop."),
]


@pytest.mark.parametrize("page, part", HAND_PAGES)
def test_extraction_of_pages_by_hand(page, part):
    text = html.trained().extract(page)
    assert part in text and not any(x in text for x in ("Home", "News", "Shop", "rights", "More like", "Related"))


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(50):
        crf = html.Crf({}, rng.normal(size=2), rng.normal(size=(2, 2)))
        e = rng.normal(size=7).tolist()

        def worth(path, crf=crf, e=e):
            return crf.start[path[0]] + sum(x for x, s in zip(e, path) if s) + sum(crf.steps[a, b] for a, b in zip(path, path[1:]))

        best = max(([k >> j & 1 for j in range(7)] for k in range(128)), key=worth)
        assert worth(crf.decode(e)) == pytest.approx(worth(best))


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = common.checkpointed(stage(spark, docs, sf))
        after = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == columns and after <= before, name
        assert len(after) > 0.8 * len(before), name
    want = plain_groups(pairs_of(docs), 5)
    assert all(i == c for i, (n, c) in want.items() if n), "near duplicates are left"
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_pipeline_stages_on_awkward_rows(spark, sf, kind):
    import corpus_pipeline

    rows = AWKWARD if kind == "awkward" else []
    for _, stage in corpus_pipeline.STAGES:
        docs = frame(spark, rows)
        out = stage(spark, docs, sf)
        assert out.count() <= len(rows)


def test_pipeline_takes_out_short_lines(spark, sf):
    import corpus_pipeline

    own = [" ".join(f"{x}{k}" for k in range(9)) for x in "abcd"]
    rows = [(1, f"All rights reserved.\n{own[0]}\nLes.", "en"), (2, f"{own[1]}\nall rights reserved.\n\nLes.", "en"), (3, f"Les.\n{own[2]}\nrights reserved.", "en"), (4, f"Les.\n{own[3]}\nLes.", "en")]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, frame(spark, rows), sf).collect()}
    assert out == {1: rows[0][1], 2: f"{own[1]}\n", 3: f"{own[2]}\nrights reserved.", 4: own[3]}


def test_decontamination_adds_up_stretches_of_a_diagonal(spark):
    item = [f"q{k}" for k in range(31)]
    text = " ".join([*item[:12], *(f"z{k}" for k in range(7)), *item[19:]])
    found = decontaminate.overlaps(frame(spark, [(1, f"a {text} b", "en")]), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert [tuple(r) for r in found] == [(1, 1, 31, 24)]


def test_short_items_are_found_despite_any_substitutions():
    from itertools import combinations

    for n in range(decontaminate.LEAST_ITEM, decontaminate.LONGEST_SHARE + 1):
        need = int(decontaminate.needed(np.array([n]))[0])
        item = [f"q{k}" for k in range(n)]
        index = decontaminate.Index([1], [" ".join(item)])
        for lost in combinations(range(n), n - need):
            text = " ".join(["x", *("y" if k in lost else w for k, w in enumerate(item)), "x"])
            assert index.find(common.Words([text.encode()])) == [(0, 0, need)], (n, lost)
        more = " ".join("y" if k % (n // (n - need + 1)) == 0 else w for k, w in enumerate(item))
        assert not index.find(common.Words([more.encode()])), n


def test_repetitive_texts_stay_small():
    index = decontaminate.Index([1], ["a " * 1000])
    began = time.perf_counter()
    assert index.find(common.Words([b"a " * 20_000])) == [(0, 0, 1000)]
    assert time.perf_counter() - began < 60
