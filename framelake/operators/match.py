"""Joins that match points, descriptors and frames."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_batches, checkpointed

#: Vectors of a block of ``two_nearest``: of 64 numbers, half a megabyte.
BLOCK = 1024


def range_join(left: DataFrame, right: DataFrame, coordinates: list[tuple[str, str]], tolerance: float, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs whose coordinates all differ by less than ``tolerance``, as an equi-join.

    Both sides get grid cells of that size; the left side is copied to the
    neighbouring cells (3 per coordinate), so every pair meets in exactly one cell
    and no theta join is left.  Column names of the two sides must differ.
    """
    on = [F.col(a) == F.col(b) for a, b in keys]
    for k, (a, b) in enumerate(coordinates):
        cell = F.floor(F.col(a) / tolerance)
        left = left.withColumn(f"__l{k}", F.explode(F.array(cell - 1, cell, cell + 1)))
        right = right.withColumn(f"__r{k}", F.floor(F.col(b) / tolerance))
        on.append(F.col(f"__l{k}") == F.col(f"__r{k}"))
    joined = left.join(right, on)
    for a, b in coordinates:
        joined = joined.filter(F.abs(F.col(a) - F.col(b)) < tolerance)
    return joined.drop(*[f"__{s}{k}" for s in "lr" for k in range(len(coordinates))])


def nearest(pairs: DataFrame, left: list[str], distance: str, tie: str) -> DataFrame:
    """The nearest partner of each left row."""
    w = Window.partitionBy(*left).orderBy(distance, tie)
    return pairs.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def offset_vote(points_a: DataFrame, points_b: DataFrame, tolerance: float = 2.5, least: int = 8, brightest: int = 80) -> DataFrame:
    """The offset (dx, dy) between two point lists that most pairs agree on: id, x, y in both, brightest first by id.

    The list of candidate offsets is bounded by ``brightest`` squared; agreement is
    counted by a bucketed range join.
    """
    a = points_a.filter(F.col("id") < brightest).select(F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points_b.filter(F.col("id") < brightest).select(F.col("x").alias("bx"), F.col("y").alias("by"))
    offsets = a.crossJoin(F.broadcast(b)).select((F.col("ax") - F.col("bx")).alias("dx"), (F.col("ay") - F.col("by")).alias("dy"))  # at most brightest ** 2 rows
    other = offsets.select(F.col("dx").alias("ox"), F.col("dy").alias("oy"))
    votes = range_join(offsets, other, [("dx", "ox"), ("dy", "oy")], tolerance).groupBy("dx", "dy").agg(F.count(F.lit(1)).alias("votes"), F.avg("ox").alias("mx"), F.avg("oy").alias("my"))
    best = votes.orderBy(F.desc("votes"), "dx", "dy").limit(1)
    return best.filter(F.col("votes") >= least).select(F.col("mx").alias("dx"), F.col("my").alias("dy"), "votes")


def _packed(df: DataFrame, name: str, v: str, side: str) -> DataFrame:
    """Rows (name, v) as rows of up to BLOCK vectors each: ``side``_ids, ``side``_values (row by row), where no vector and no number is null."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                flat = part.column(1).flatten()
                ends = lambda n: pa.array([0, n], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends(part.num_rows), part.column(0)), pa.ListArray.from_arrays(ends(len(flat)), flat)], names=[f"{side}_ids", f"{side}_values"])

    rows = df.select(F.col(name).cast("bigint"), F.col(v).cast("array<double>").alias(v)).dropna().filter(F.forall(v, lambda x: x.isNotNull()))
    return rows.mapInArrow(pack, f"{side}_ids array<bigint>, {side}_values array<double>")


def _two_of_block(q: np.ndarray, iv: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the queries the places (in iv) of its two nearest by squared distance, then id, and those distances; -1 and infinity where there are fewer.

    One product of matrices rules out nearly all; distances of the rest are added up
    number by number, as an expression would.
    """
    n, m = len(q), len(iv)
    norm = (iv * iv).sum(axis=1)
    own = (q * q).sum(axis=1)
    near = own[:, None] + norm - 2 * (q @ iv.T)
    slack = 1e-12 * (own + norm.max()) + 1e-300
    reach = (np.partition(near, 1, axis=1)[:, 1] if m > 1 else near[:, 0]) + slack
    row, col = np.nonzero(~(near > reach[:, None]))
    d = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):  # a slice at a time, of many copies too
        some = slice(at, at + (1 << 16))
        d[some] = np.cumsum((q[row[some]] - iv[col[some]]) ** 2, axis=1)[:, -1]
    order = np.lexsort((ids[col], d, row))
    row, col, d = row[order], col[order], d[order]
    first = np.searchsorted(row, np.arange(n))
    places, far = np.full((n, 2), -1), np.full((n, 2), np.inf)
    for k in range(min(2, m)):
        places[:, k], far[:, k] = col[first + k], d[first + k]
    return places, far


def two_nearest(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Distances to the two nearest vectors: q, best, d1, d2; rows with a null vector or number are left out.

    All pairs are compared, block by block: both sides are packed into rows of up to
    BLOCK vectors, each pair of blocks is one product of matrices, and two rows a
    query and block are left.  A task holds two blocks and their distances.
    """
    bounded_batches(queries.sparkSession)
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    both = _packed(queries, "q", "qv", "q").repartition(2 * tasks).crossJoin(_packed(index, "i", "iv", "i").repartition(max(1, tasks // 2)))

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                q, qv, i, iv = (batch.column(c)[k].values.to_numpy() for c in ("q_ids", "q_values", "i_ids", "i_values"))
                places, far = _two_of_block(qv.reshape(len(q), -1), iv.reshape(len(i), -1), i)
                known = places.ravel() >= 0
                out.append((np.repeat(q, 2)[known], i[places.ravel()[known]], far.ravel()[known]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["q", "i", "d"]) if out else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["q", "i", "d"])

    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "i"))
    two = both.mapInArrow(run, "q bigint, i bigint, d double").withColumn("place", place).filter("place <= 2")
    at = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    return two.groupBy("q").agg(at("i", 1).alias("best"), F.sqrt(at("d", 1)).alias("d1"), F.sqrt(at("d", 2)).alias("d2"))


def ratio_match(queries: DataFrame, index: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Matches whose nearest partner is clearly nearer than the second."""
    return two_nearest(queries, index).filter(F.col("d1") < ratio * F.col("d2"))


def mutual_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest: a and b hold (q, qv)."""
    there = two_nearest(a, b.select(F.col("q").alias("i"), F.col("qv").alias("iv"))).select(F.col("q").alias("a"), F.col("best").alias("b"), "d1")
    back = two_nearest(b, a.select(F.col("q").alias("i"), F.col("qv").alias("iv"))).select(F.col("q").alias("b"), F.col("best").alias("a"))
    return there.join(back, ["a", "b"])


def duplicate_distance(df: DataFrame, series: list[str], frame: str, position: list[str], value: str = "v") -> DataFrame:
    """1 - correlation of consecutive frames of a series: a, b, distance.

    Only neighbours in order are compared, by a lag over each pixel's values.
    """
    w = Window.partitionBy(*series, *position).orderBy(frame)
    both = df.withColumns({"b": F.lag(frame).over(w), "bv": F.lag(value).over(w)}).filter("b IS NOT NULL")
    n = F.count(F.lit(1))
    below = F.sqrt(n * F.var_pop(value)) * F.sqrt(n * F.var_pop("bv")) + 1e-6
    return both.groupBy(*series, F.col(frame).alias("a"), "b").agg((1.0 - n * F.covar_pop(value, "bv") / below).alias("distance"))


def cone_search(catalogue: DataFrame, ra: float, dec: float, radius: float, order: str, most: int = 800) -> DataFrame:
    """Rows within ``radius`` degrees, the first by ``order``: needs ra, dec in degrees.

    A filter on dec alone can be pushed to the scan; the great-circle test follows.
    """
    near = catalogue.filter(F.col("dec").between(dec - radius, dec + radius))
    half = lambda x: F.pow(F.sin(F.radians(x) / 2.0), F.lit(2.0))
    chord = half(F.col("dec") - dec) + F.cos(F.radians("dec")) * F.cos(F.radians(F.lit(dec))) * half(F.col("ra") - ra)
    return near.withColumn("separation", F.degrees(2.0 * F.asin(F.sqrt(chord)))).filter(F.col("separation") <= radius).orderBy(order).limit(most)


def channel_gains(df: DataFrame, low: float = 0.4, high: float = 2.5, least: int = 10) -> DataFrame:
    """Median ratio of catalogue to measured colour per channel, cut to [low, high]; needs channel, measured, expected."""
    gains = df.groupBy("channel").agg(F.median(F.col("expected") / F.col("measured")).alias("gain"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return gains.select("channel", F.least(F.greatest("gain", F.lit(low)), F.lit(high)).alias("gain"), "n")


def pair_graph(edges: DataFrame, start: int = 0) -> DataFrame:
    """Product of factors along shortest paths from ``start`` (breadth first): node, depth, factor; edges i, j, factor in both directions.

    One join per level, until a level reaches no new node; equal depths take the smaller predecessor, and of
    its edges the one with the smaller product.
    """
    spark = edges.sparkSession
    edges = edges.select("i", "j", "factor")
    edges = checkpointed(edges.union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), (1.0 / F.col("factor")).alias("factor"))))
    reached = spark.createDataFrame([(start, 0, 1.0)], "node bigint, depth int, factor double")
    frontier = reached
    for depth in itertools.count(1):
        here = frontier.select(F.col("node").alias("i"), F.col("factor").alias("so_far"))
        step = here.join(edges, "i").select("j", "i", (F.col("so_far") * F.col("factor")).alias("f"))
        step = step.groupBy("j").agg(F.min_by("f", F.struct("i", "f")).alias("factor")).select(F.col("j").alias("node"), F.lit(depth).alias("depth"), "factor")
        frontier = checkpointed(step.join(reached.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        reached = checkpointed(reached.union(frontier))
    return reached


def triangles(points: DataFrame, frame: list[str], most: int = 60) -> DataFrame:
    """Side ratios of all triangles of a frame's first points: a, b, c, r1, r2 with r1 <= r2 <= 1.  Bounded by ``most`` points per frame."""
    p = points.filter(F.col("id") < most)
    side = lambda s: p.select(*frame, F.col("id").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    t = side("a").join(side("b"), frame).filter("a < b").join(side("c"), frame).filter("b < c")
    length = lambda s, u: F.hypot(F.col(f"{s}x") - F.col(f"{u}x"), F.col(f"{s}y") - F.col(f"{u}y"))
    t = t.withColumn("s", F.array_sort(F.array(length("a", "b"), length("b", "c"), length("a", "c"))))
    return t.filter("s[2] > 0").select(*frame, "a", "b", "c", F.expr("s[0] / s[2]").alias("r1"), F.expr("s[1] / s[2]").alias("r2"))


def triangle_votes(ref: DataFrame, mov: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Votes for pairs of points whose triangles are alike: a triangle's corners meet in order of the opposite sides' ids."""
    left = ref.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("c").alias("rc"), F.col("r1").alias("p1"), F.col("r2").alias("p2"))
    right = mov.select(F.col("a").alias("ma"), F.col("b").alias("mb"), F.col("c").alias("mc"), F.col("r1").alias("q1"), F.col("r2").alias("q2"))
    alike = range_join(left, right, [("p1", "q1"), ("p2", "q2")], tolerance)
    pairs = alike.select(F.explode(F.array(*[F.struct(F.col(f"r{s}").alias("ref"), F.col(f"m{u}").alias("mov")) for s in "abc" for u in "abc"])).alias("p"))
    return pairs.groupBy("p.ref", "p.mov").agg(F.count(F.lit(1)).alias("votes"))
