"""Near-duplicate groups from SetSketch registers, confirmed on full shingle sets.

A sketch has REGISTERS registers.  Register i of a set is
``floor(1 - log_b(min over elements of an exponential variate))``, cut to 0..255:
an exponentially spaced, truncated minimum.  The register-wise maximum of two
sketches is the sketch of the union, and equal registers are the likelier the more
two sets overlap, so bands of registers serve as bucket keys.

Steps
  1. Documents with equal shingle sets form one class, named by its least doc_id.
  2. Each class goes into one bucket per band.  A star of pairs (member, least
     member) stands for a bucket, so a bucket of n classes gives n - 1 pairs.
  3. A pair is estimated by the joint likelihood of all its registers and, unless
     that rules it out, confirmed on the full sets.
  4. Confirmed links make components.  In buckets that still span several, pairs
     across components are estimated where the bucket stands, in cells of bounded
     size; a cell gives out a spanning forest of its likely pairs, likeliest first,
     so no more pairs than it has members.  These are confirmed, too.
  5. Where that leaves a tree of likely pairs in several components, its members meet
     with their full sets, again in cells: all likely pairs across components are
     tested there, and only links that join two components are given out.
So every likely pair that shares a bucket was either tested or lies in one component
already.  What steps 1 to 3 move grows with members.  Steps 4 and 5 copy a member to
one cell for each CELL members of its open bucket (or each CELL_SHINGLES shingles of its
open tree), so a bucket of n members that stays in several components moves n**2 / CELL
rows; a bucket whose star holds it together, as groups of copies do, moves none.

Chance of missing a pair at a similarity of exactly 0.8: (1 - 0.8**ROWS)**BANDS, 1e-7.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROWS, BANDS = 5, 40
REGISTERS = ROWS * BANDS
BASE = 1.1
RATE = 20.0
#: A pair whose estimate is lower than the threshold by this is ruled out: four standard deviations.
SLACK = 0.11
#: Members of a bucket that one cell holds at most, on average; shingles of the sets of one.
CELL = 1500
CELL_SHINGLES = 1 << 20
#: Links that one task joins to components; beyond that, rounds of joins do.
MOST_LINKS = 1 << 21

_MULTIPLIERS = common.random_words(REGISTERS, 11) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, 64-bit shingle hash), ascending; a text with fewer words is one shingle, one without words has none."""
    words = common.Words(texts, lower=True)
    hashes = words.hashes(3)
    at = common.runs_in_docs(words, width)
    doc, value = words.doc[at], common.window_hashes(hashes, width, 3)[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    for d in short.tolist():
        own = hashes[words.first[d] : words.first[d + 1]]
        doc = np.append(doc, d)
        value = np.append(value, common.window_hashes(own, len(own), 4))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def registers(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sketches of the sets value[first[i]:first[i+1]], none of them empty."""
    out = np.empty((len(first) - 1, REGISTERS), dtype=np.uint8)
    starts = first[:-1]
    x = np.empty_like(value)
    for i in range(REGISTERS):
        np.multiply(value, _MULTIPLIERS[i], out=x)  # values are hashes already: an odd factor gives another order
        least = np.minimum.reduceat(x, starts)
        uniform = (least.astype(np.float64) + 0.5) / 2.0**64
        variate = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, 255).astype(np.uint8)
    return out


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs of sketches whose sets have known sizes."""
    return _likeliest((a > b).sum(axis=1), (a < b).sum(axis=1), size_a, size_b, a.shape[1])


def _likeliest(more: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, m: int) -> np.ndarray:
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    above, below = _p(np.maximum(u - v * grid, 1e-12)), _p(np.maximum(v - u * grid, 1e-12))
    same = np.maximum(1 - above - below, 1e-12)
    like = more[:, None] * np.log(above) + less[:, None] * np.log(below) + (m - more - less)[:, None] * np.log(same)
    return grid[np.arange(len(grid)), like.argmax(axis=1)]


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band."""
    rows = np.ascontiguousarray(sketches).astype(np.uint64).reshape(len(sketches), BANDS, ROWS)
    packed = np.zeros((len(sketches), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        packed = packed << np.uint64(8) | rows[:, :, r]
    return common.mix64(packed ^ np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] << np.uint64(48))


def sketch_rows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (hash of the set) and sketch; for an empty set s1, s2 and sketch are null."""

    def run(batches):
        for batch in batches:
            texts = common.raw_texts(batch.column("text"))
            for i, j in common.blocks(texts):
                doc, value = shingle_sets(texts[i:j], width)
                n = np.bincount(doc, minlength=j - i)
                some = np.flatnonzero(n > 0)
                first = np.concatenate(([0], np.cumsum(n[some])))
                s1, s2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                sketches = [None] * (j - i)
                if len(some):
                    s1[some] = np.add.reduceat(common.mix64(value ^ np.uint64(0x5851F42D4C957F2D)), first[:-1])
                    s2[some] = np.add.reduceat(common.mix64(value ^ np.uint64(0x14057B7EF767814F)), first[:-1])
                    for k, s in zip(some.tolist(), registers(value, first)):
                        sketches[k] = s.tobytes()
                none = n == 0
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(common.signed(s1), mask=none), pa.array(common.signed(s2), mask=none), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "s1", "s2", "sketch"])

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, sketch binary")


def attach(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``table`` (cid, ...) for both ends of pairs (a, b), named a_<column> and b_<column>.

    A class may be in very many pairs, yet has one row in ``table``: these are plain
    shuffled joins, whose large partitions Spark splits on the side of the pairs.
    """
    side = lambda x: table.select(F.col("cid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    return pairs.join(side("b"), "b").join(side("a"), "a")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the registers' joint likelihood does not rule out."""
    low = percent / 100 - SLACK

    def run(batches):
        for batch in common.gathered(batches, 4000):
            n = batch.num_rows
            sizes = [batch.column(c).to_numpy() for c in ("a_n_shingles", "b_n_shingles")]
            sketches = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(n, -1) for c in ("a_sketch", "b_sketch")]
            good = 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
            good &= estimate(*sketches, *sizes) >= low
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    return common.arrow_map(attach(pairs, classes, ["n_shingles", "sketch"]), run, "a bigint, b bigint")


def texts_of(docs: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """(cid, text, column) of the documents whose ids are in ``lists`` (cid, column)."""
    texts = docs.select(F.col("doc_id").alias("cid"), "text").filter("cid IS NOT NULL AND text IS NOT NULL")
    return common.with_lists(texts, lists, "cid", column, "inner")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on the full sets.  Texts are read again, for these pairs only."""
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct().withColumn("none", F.lit(b""))

    def pack(batches):
        for batch in batches:
            packed = [zlib.compress(b" ".join(t.lower().split()), 1) for t in common.raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(packed, pa.binary())], names=["cid", "z"])

    def run(batches):
        held: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            za, zb = batch.column("a_z"), batch.column("b_z")
            sure = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                raw = za[k].as_py()
                if raw != held[0]:
                    held = (raw, shingle_sets([zlib.decompress(raw)], width)[1])
                other = shingle_sets([zlib.decompress(zb[k].as_py())], width)[1]
                both = len(np.intersect1d(held[1], other, assume_unique=True))
                sure[k] = 100 * both >= percent * (len(held[1]) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(sure)) for c in ("a", "b")], names=["a", "b"])

    packed = common.checkpointed(common.arrow_map(texts_of(docs, needed, "none").select("cid", "text"), pack, "cid bigint, z binary"))
    return common.arrow_map(attach(pairs, packed, ["z"]).select("a", "b", "a_z", "b_z"), run, "a bigint, b bigint")


def joined(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``label`` with the trees of u[k] and v[k] joined; a root is the least index of its tree."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b).

    Up to MOST_LINKS links are joined in one task.  More take alternating large-star
    and small-star rounds: each is a minimum per node, taken before the shuffle, and a
    join back on the node, which Spark splits where a node is frequent.
    """
    edges = common.checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    if edges.count() <= MOST_LINKS:

        def run(batches):
            rows = list(batches)
            u, v = (np.concatenate([b.column(c).to_numpy() for b in rows]) if rows else np.zeros(0, np.int64) for c in ("u", "v"))
            nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
            label = joined(place[: len(u)], place[len(u) :], np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])

        return common.checkpointed(common.arrow_map(edges.coalesce(1), run, "node bigint, component bigint"))
    while not is_stars(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))  # so Spark can split the join
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def is_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    mixed = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR out + into > 1")
    return mixed.isEmpty()


def in_cells(members: DataFrame, group: str) -> DataFrame:
    """Each member in the cells where its part meets each other part of its group: columns part, p, q; sorted by group and cell."""
    part = F.pmod(F.xxhash64("cid"), F.col("parts").cast("bigint")).cast("int")
    cells = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("other", "parts")
    return cells.repartition(group, "p", "q").sortWithinPartitions(group, "p", "q")


def by_cell(batches, group: str):
    """The rows of each cell, one after the other."""
    held = None
    for batch in common.gathered(batches, 4000):
        rows = batch if held is None else pa.concat_batches([held, batch])
        g, p, q = common.numbers(rows, group, "p", "q")
        edges = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1).tolist()]
        for i, j in zip(edges[:-1], edges[1:]):
            yield rows.slice(i, j - i)
        held = rows.slice(edges[-1])
    if held is not None:
        yield held


def likely_pairs(cell: pa.RecordBatch, low: float):
    """(a, b, estimate) of a cell's pairs across components that the registers don't rule out, in blocks; a is on the side p, b on q."""
    comp, part, p, q, cid, n = common.numbers(cell, "comp", "part", "p", "q", "cid", "n_shingles")
    if len(cid) < 2 or (comp == comp[0]).all():
        return
    sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(cid), -1)
    left = np.flatnonzero(part == p[0])
    right = left if p[0] == q[0] else np.flatnonzero(part == q[0])
    for i in range(0, len(left), 64):
        x = left[i : i + 64]
        ok = (comp[x][:, None] != comp[right][None, :]) & (np.minimum(n[x][:, None], n[right][None, :]) >= low * np.maximum(n[x][:, None], n[right][None, :]))
        if p[0] == q[0]:
            ok &= x[:, None] < right[None, :]
        at, to = np.nonzero(ok)
        for k in range(0, len(at), 8192):
            a, b = x[at[k : k + 8192]], right[to[k : k + 8192]]
            near = (sketch[a] == sketch[b]).sum(axis=1) >= (low - 0.05) * REGISTERS
            a, b = a[near], b[near]
            if len(a):
                e = estimate(sketch[a], sketch[b], n[a], n[b])
                if (e >= low).any():
                    yield a[e >= low], b[e >= low], e[e >= low]


def forest(members: DataFrame, low: float) -> DataFrame:
    """Spanning forests (a, b) of the likely pairs across components within buckets, the likeliest first: members has bucket, cid, comp, n_shingles, sketch, parts."""

    def run(batches):
        for cell in by_cell(batches, "bucket"):
            label, a_out, b_out = np.arange(cell.num_rows), [], []
            found = list(likely_pairs(cell, low))
            if not found:
                continue
            a, b, e = (np.concatenate(x) for x in zip(*found))
            while len(a):  # Boruvka: each tree's likeliest pair
                best = np.full(len(label), -1.0)
                np.maximum.at(best, label[a], e)
                np.maximum.at(best, label[b], e)
                chosen = np.flatnonzero((e >= best[label[a]]) | (e >= best[label[b]]))
                _, one = np.unique(np.minimum(label[a], label[b])[chosen] * len(label) + np.maximum(label[a], label[b])[chosen], return_index=True)
                chosen = chosen[one]
                a_out.append(a[chosen])
                b_out.append(b[chosen])
                label = joined(a[chosen], b[chosen], label)
                apart = label[a] != label[b]
                a, b, e = a[apart], b[apart], e[apart]
            a, b = np.concatenate(a_out), np.concatenate(b_out)
            keep = spanning(a, b, cell.num_rows)
            cid = cell.column("cid").to_numpy()
            a, b = cid[a[keep]], cid[b[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return common.arrow_map(in_cells(members, "bucket"), run, "a bigint, b bigint").distinct()


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges, taken in turn, join two trees."""
    parent, keep = list(range(n)), np.zeros(len(a), dtype=bool)

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def exact_links(members: DataFrame, low: float, percent: int) -> DataFrame:
    """Links (a, b) that join components, found on full sets: members has cluster, cid, comp, n_shingles, sketch, shingles, parts.

    A cell tests all its likely pairs whose ends it hasn't joined yet.
    """

    def run(batches):
        for cell in by_cell(batches, "cluster"):
            found = list(likely_pairs(cell, low))
            if not found:
                continue
            a, b, e = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((-e, a))
            a, b = a[order], b[order]
            sets = [np.frombuffer(x, dtype=np.uint64) for x in cell.column("shingles").to_pylist()]
            size = np.array([len(x) for x in sets])
            _, label = np.unique(cell.column("comp").to_numpy(), return_inverse=True)
            label = np.unique(label, return_index=True)[1][label]  # the root is the first member
            out = []
            edge = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(a)]):
                one, rest, step = int(a[i]), b[i:j], 8
                while len(rest := rest[label[rest] != label[one]]):
                    now, rest = rest[:step], rest[step:]
                    step = min(4 * step, 512)
                    flat = np.concatenate([sets[k] for k in now.tolist()])
                    at = np.minimum(np.searchsorted(sets[one], flat), size[one] - 1)
                    both = np.add.reduceat((sets[one][at] == flat).astype(np.int64), np.cumsum(size[now]) - size[now])
                    for k in now[100 * both >= percent * (size[one] + size[now] - both)].tolist():
                        if label[k] != label[one]:
                            label[label == max(label[k], label[one])] = min(label[k], label[one])
                            out.append((one, k))
            if out:
                cid = cell.column("cid").to_numpy()
                x, y = cid[np.array(out).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return common.arrow_map(in_cells(members, "cluster"), run, "a bigint, b bigint").distinct()


def open_members(docs: DataFrame, trees: DataFrame, label: DataFrame, width: int) -> DataFrame | None:
    """Members of trees of likely pairs that lie in several components, with their full sets; None if there are none."""
    cluster = components(trees).select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    named = cluster.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    named = common.checkpointed(named.select("cid", "cluster", "comp"))
    still = common.checkpointed(named.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("cluster"))
    if still.isEmpty():
        return None
    named = named.join(still, "cluster").select("cid", F.concat(F.hex("cluster"), F.lit(","), F.hex("comp")).cast("binary").alias("own"))

    def run(batches):
        for batch in batches:
            cid, own = batch.column("cid").to_numpy(), batch.column("own").to_pylist()
            texts = common.raw_texts(batch.column("text"))
            for i, j in common.blocks(texts):
                doc, value = shingle_sets(texts[i:j], width)
                n = np.bincount(doc, minlength=j - i)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                first = np.concatenate(([0], np.cumsum(n[some])))
                ends = [[int(x, 16) for x in own[i + k].split(b",")] for k in some.tolist()]
                columns = [
                    pa.array([x[0] for x in ends], pa.uint64()).view(pa.int64()),
                    pa.array(cid[i:j][some]),
                    pa.array([x[1] for x in ends], pa.uint64()).view(pa.int64()),
                    pa.array(n[some]),
                    pa.array([x.tobytes() for x in registers(value, first)], pa.binary()),
                    pa.array([value[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["cluster", "cid", "comp", "n_shingles", "sketch", "shingles"])

    schema = "cluster bigint, cid bigint, comp bigint, n_shingles bigint, sketch binary, shingles binary"
    found = common.checkpointed(common.arrow_map(texts_of(docs, named, "own"), run, schema))
    parts = found.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n_shingles") / CELL_SHINGLES), F.ceil(F.count(F.lit(1)) / CELL)).cast("int").alias("parts"))
    return found.join(parts, "cluster")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Texts are lower-cased (A-Z) and cut into words; two documents are linked if
    their sets of ``width``-word shingles overlap by ``percent`` of the union.
    component_id is the least doc_id reachable.  A text without words is linked
    with nothing.  Rows that share a doc_id are one document, linked if any of its
    texts is.  A null doc_id can't be linked: its component_id is null and it is
    kept.  Texts of any length count whole, in blocks of 1 MB or one text.  Further
    columns aren't read.  An empty table stays empty.
    """
    member = common.checkpointed(sketch_rows(docs, width))
    usable = member.filter("doc_id IS NOT NULL AND n_shingles > 0")
    grouped = usable.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("most"), F.first("sketch").alias("sketch"))
    classes = common.checkpointed(grouped)

    def bands(batches):
        for batch in common.gathered(batches, 2000):
            n = batch.num_rows
            keys = band_keys(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(n, -1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(common.signed(keys.ravel())), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(np.repeat(batch.column("cid").to_numpy(), BANDS))],
                names=["bucket", "band", "cid"],
            )

    banded = common.arrow_map(classes.select("cid", "sketch"), bands, "bucket bigint, band int, cid bigint")
    # Written out, so that the join has a shuffle on both sides and Spark can split a frequent bucket.
    shared = common.checkpointed(banded.groupBy("bucket").agg(F.min("cid").alias("a"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    in_bucket = common.checkpointed(banded.join(shared, "bucket"))
    star = in_bucket.filter("cid > a").select("a", F.col("cid").alias("b")).distinct()
    found = common.checkpointed(confirm(common.checkpointed(likely(star, classes, percent)), docs, width, percent))
    label = components(found)
    low = percent / 100 - SLACK
    named = in_bucket.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    open_buckets = common.checkpointed(named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket"))
    if not open_buckets.isEmpty():
        left_over = named.select("bucket", "cid", "size", "comp").join(open_buckets, "bucket").join(classes.select("cid", "n_shingles", "sketch"), "cid")
        left_over = left_over.withColumn("parts", F.ceil(F.col("size") / F.lit(CELL)).cast("int")).drop("size")
        trees = common.checkpointed(forest(left_over, low))
        found = common.checkpointed(found.union(confirm(trees, docs, width, percent)))
        label = components(found)
        members = open_members(docs, trees, label, width)
        if members is not None:
            label = components(found.union(exact_links(members, low, percent)))

    # Class of each document by its set, then the component of the class: both joins leave singletons alone.
    by_set = classes.filter("rows > 1 AND most > cid").select("s1", "s2", F.col("cid").alias("first_copy"))
    out = member.drop("sketch").join(by_set, ["s1", "s2"], "left").withColumn("cid", F.when(F.col("doc_id").isNotNull(), F.coalesce("first_copy", "doc_id")))
    out = out.join(label.withColumnRenamed("node", "cid"), "cid", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "cid").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=2)


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the least of its near-duplicate group; columns unchanged.  Rows that repeat a kept doc_id count as that document and stay with it."""
    kept = near_duplicates(docs, width, percent).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
