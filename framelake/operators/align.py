"""Alignment of the frames of a series: chained transforms, and registration over bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrices as mx
from ..session import checkpointed, stored
from . import match, scan


def frame_moments(px: DataFrame, frame: list[str], value: str = "v") -> DataFrame:
    """Centre (cx, cy) and direction of the main axis (angle, in (-pi/2, pi/2]) of each frame's values, which weigh pixels (y, x)."""
    w, x, y = F.col(value), F.col("x"), F.col("y")
    sums = px.groupBy(*frame).agg(F.sum(w).alias("w"), *[F.sum(w * t).alias(n) for n, t in {"wx": x, "wy": y, "xx": x * x, "xy": x * y, "yy": y * y}.items()])
    sums = sums.withColumns({"cx": F.col("wx") / F.col("w"), "cy": F.col("wy") / F.col("w")})
    spread = {"a": F.col("xx") / F.col("w") - F.col("cx") ** 2, "b": F.col("xy") / F.col("w") - F.col("cx") * F.col("cy"), "c": F.col("yy") / F.col("w") - F.col("cy") ** 2}
    return sums.withColumns(spread).select(*frame, "cx", "cy", (0.5 * F.atan2(2.0 * F.col("b"), F.col("a") - F.col("c"))).alias("angle"))


def moment_steps(moments: DataFrame, series: list[str], order: list[str], most_turn: float = 0.6, most_shift: float = 1.0) -> DataFrame:
    """``moments`` with k, the frame's number in its series, and back: the rigid move to the frame before, null where it turns or shifts too far.

    Neighbours meet by an equi-join on (series, k); axes have no direction, so the
    smaller of the two turns counts.
    """
    placed = checkpointed(scan.positions(moments, series, order))
    before = placed.select(*series, (F.col("k") + 1).alias("k"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("angle").alias("pa"))
    turn = F.col("pa") - F.col("angle")
    both = placed.join(before, [*series, "k"], "left").withColumn("turn", turn - F.lit(3.141592653589793) * F.round(turn / 3.141592653589793))
    cos, sin = F.cos("turn"), F.sin("turn")
    tx, ty = F.col("px") - (cos * F.col("cx") - sin * F.col("cy")), F.col("py") - (sin * F.col("cx") + cos * F.col("cy"))
    near = (F.abs("turn") <= most_turn) & (F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy")) <= most_shift)
    return both.withColumn("back", F.when(near, mx.rigid(cos, sin, tx, ty))).drop("px", "py", "pa", "turn")


def align_sequential(frames: DataFrame, series: list[str], k: str = "k", back: str = "back", ahead: str | None = None) -> DataFrame:
    """Each frame's transform to its series' middle frame, chained over neighbours.

    ``frames`` holds a row per frame: its number ``k`` in the series (from 0, without
    gaps), ``back``, a 3x3 matrix to the frame before, and maybe ``ahead``, one to
    the next frame (else the inverse of that frame's ``back``).  Frame n // 2 of n is
    the reference.  A pair without a matrix, or with one that can't be inverted,
    counts as unmoved.  Returns the frames with m (array of nine), steps (frames on
    the way) and failed (pairs on the way without a matrix).

    Scale: both sides of a series are segmented scans of matrix products, so one
    long series is spread over tasks.  Null series are a series; an empty table
    stays empty.
    """
    counts = frames.groupBy(*series).agg((F.count(F.lit(1)).cast("bigint")).alias("__n"))
    same = [F.col(f"l.{s}").eqNullSafe(F.col(f"r.{s}")) for s in series]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    both = frames.alias("l").join(counts.alias("r"), condition).select("l.*", "__n").withColumn("__d", F.col(k) - F.expr("__n DIV 2"))
    if ahead is None:
        following = frames.select(*series, (F.col(k) - 1).alias(k), mx.inverse(back).alias("__ahead"))
        both = both.alias("l").join(following.alias("r"), condition & (F.col(f"l.{k}") == F.col(f"r.{k}")), "left").select("l.*", "__ahead")
        ahead = "__ahead"
    step = F.when(F.col("__d") > 0, F.col(back)).when(F.col("__d") < 0, F.col(ahead)).otherwise(mx.identity())
    both = both.withColumn("__step", step).withColumns({"__side": F.signum("__d").cast("int"), "__far": F.abs("__d")})
    lost = F.col("__step").isNull()
    state = F.concat(F.coalesce("__step", mx.identity()), F.array(F.when(lost, 1.0).otherwise(0.0)))
    out = scan.segmented_scan(both.withColumn("__state", state), [*series, "__side"], ["__far"], "__state", scan.multiply_matrices, "__m")
    out = out.withColumns({"m": F.slice("__m", 1, 9), "steps": F.col("__far"), "failed": F.element_at("__m", 10).cast("bigint")})
    return out.drop("__n", "__d", "__ahead", "__step", "__side", "__far", "__state", "__m")


def spanning_transforms(nodes: DataFrame, edges: DataFrame, series: list[str]) -> DataFrame:
    """For every node its tree's root and the transform to it, along the best spanning forest of each series.

    ``nodes``: series..., node.  ``edges``: series..., a, b, m (a's coordinates to
    b's), rank (a struct or number, smaller is better).  Edges between the same
    two nodes may repeat; ties in rank go to the smaller ids.  Matrices that can't be
    inverted and edges to unknown nodes don't count.

    Every round each tree takes its best edge to another one; trees that pick each
    other leave the smaller root, chains of picks are followed by doubling, and
    matrices are multiplied on the way.  So the rounds grow with the logarithm of
    a series' frames, even where these form one long chain, and each is a few
    equi-joins on (series, root).
    """
    one = [*series, "a", "b"]
    there = edges.select(*one, "m", "rank").withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    back = there.select(*series, F.col("b").alias("a"), F.col("a").alias("b"), mx.inverse("m").alias("m"), "rank", "lo", "hi")
    known = lambda c: nodes.select(*series, F.col("node").alias(c)).distinct()
    live = there.filter(mx.inverse("m").isNotNull()).unionByName(back.filter("m IS NOT NULL")).filter("a <> b")
    live = stored(live.join(known("a"), [*series, "a"], "left_semi").join(known("b"), [*series, "b"], "left_semi").withColumn("key", F.struct("rank", "lo", "hi")).select(*one, "m", "key"))
    tree = stored(known("node").withColumns({"root": F.col("node"), "p": mx.identity()}))
    while True:
        live = live.groupBy(*one).agg(F.min_by("m", "key").alias("m"), F.min("key").alias("key"))  # parallel edges
        picks = live.groupBy(*series, "a").agg(F.min_by(F.struct("b", "m"), "key").alias("best")).select(*series, F.col("a").alias("root"), F.col("best.b").alias("up"), F.col("best.m").alias("r"))
        picks = stored(picks)
        if picks.isEmpty():
            return tree
        other = picks.select(*series, F.col("root").alias("up"), F.col("up").alias("up2"), F.col("r").alias("r2"))
        joined = picks.join(other, [*series, "up"])
        mutual = (F.col("up2") == F.col("root")) & (F.col("root") < F.col("up"))
        heads = joined.select(*series, "root", F.when(mutual, F.col("root")).otherwise(F.col("up")).alias("up"), F.when(mutual, mx.identity()).otherwise(F.col("r")).alias("r"))
        heads = stored(heads)
        while True:
            above = heads.select(*series, F.col("root").alias("up"), F.col("up").alias("up2"), F.col("r").alias("r2"))
            joined = stored(heads.join(above, [*series, "up"]))
            heads = joined.select(*series, "root", F.col("up2").alias("up"), mx.product("r2", "r").alias("r"))
            if joined.filter("up <> up2").isEmpty():
                break
        moved = tree.join(heads, [*series, "root"], "left")
        tree = stored(
            moved.select(*series, "node", F.coalesce("up", "root").alias("root"), F.when(F.col("up").isNull(), F.col("p")).otherwise(mx.product("r", "p")).alias("p"))
        )
        at = lambda c: heads.select(*series, F.col("root").alias(c), F.col("up").alias(f"{c}_up"), F.col("r").alias(f"{c}_r"))
        live = live.join(at("a"), [*series, "a"]).join(at("b"), [*series, "b"]).filter("a_up <> b_up")
        live = live.withColumn("from", mx.inverse("a_r")).withColumn("m", mx.product("m", "from")).withColumn("m", mx.product("b_r", "m"))
        live = stored(live.select(*series, F.col("a_up").alias("a"), F.col("b_up").alias("b"), "m", "key"))


def register(frames: DataFrame, pairs: DataFrame, series: list[str], points: DataFrame | None = None, within: float = 1.5, least: int = 25) -> DataFrame:
    """Every frame's transform to the reference of its series, or the reason why it has none.

    ``frames``: series..., frame, reference (boolean, true for one frame of a
    series).  ``pairs``: series..., mov, ref (frames), m (3x3, from mov's coordinates
    to ref's), score (higher is better).  Pairs with the reference win over all
    others; frames without one are bridged along the best spanning tree.  With
    ``points`` (series..., frame, x, y), a bridged frame must bring ``least`` of the
    reference's points within ``within`` of one of its own.

    Returns series..., frame, m (null without a transform) and state: ``reference``,
    ``direct``, ``bridged``, ``unverified`` (too few points agree), ``apart`` (no
    chain of pairs to the reference), ``unpaired`` (in no pair) or ``no reference``.
    Repeated frames count once; a null frame or series is left out.  Pairs of
    unknown frames, without a score, or with a matrix that can't be inverted don't count.
    """
    key = [*series, "frame"]
    frames = frames.dropna(subset=key).groupBy(*key).agg(F.bool_or(F.coalesce("reference", F.lit(False))).alias("reference"))
    head = frames.filter("reference").groupBy(*series).agg(F.min("frame").alias("head"))
    known = lambda c: frames.select(*series, F.col("frame").alias(c))
    sound = pairs.filter("score IS NOT NULL AND mov <> ref").filter(mx.inverse("m").isNotNull()).join(known("mov"), [*series, "mov"], "left_semi").join(known("ref"), [*series, "ref"], "left_semi")
    edges = sound.join(head, series, "left")
    apart = F.when((F.col("mov") == F.col("head")) | (F.col("ref") == F.col("head")), 0).otherwise(1)
    edges = edges.select(*series, F.col("mov").alias("a"), F.col("ref").alias("b"), "m", F.struct(apart.alias("apart"), (-F.col("score")).alias("worse")).alias("rank"))
    edges = stored(edges)
    tree = spanning_transforms(frames.select(*series, F.col("frame").alias("node")), edges, series)
    heads = tree.join(head, series).filter("node = head").select(*series, F.col("root").alias("head_root"), mx.inverse("p").alias("to_head"), "head")
    ends = edges.select(*series, F.col("a").alias("frame"), F.col("b").alias("with")).union(edges.select(*series, "b", "a")).join(head, series, "left")
    ends = ends.groupBy(*key).agg(F.bool_or(F.coalesce(F.col("with") == F.col("head"), F.lit(False))).alias("direct"))
    out = tree.withColumnRenamed("node", "frame").join(heads, series, "left").join(ends, key, "left")
    state = (
        F.when(F.col("head").isNull(), "no reference").when(F.col("frame") == F.col("head"), "reference").when(F.col("direct").isNull(), "unpaired")
        .when(F.col("root") != F.col("head_root"), "apart").when(F.col("direct"), "direct").otherwise("bridged")
    )
    out = out.withColumns({"state": state, "m": F.when(F.col("root") == F.col("head_root"), mx.product("to_head", "p"))}).select(*key, "m", "state", "head")
    if points is not None:
        out = checkpointed(out)
        bridged = out.filter("state = 'bridged'")
        x, y = mx.moved("m", "x", "y")
        mine = points.join(bridged, key).select(*[F.col(s).alias(f"__{s}") for s in series], F.col("frame").alias("__frame"), x.alias("mx"), y.alias("my"))
        theirs = points.join(head, series).filter("frame = head").select(*series, F.col("x").alias("hx"), F.col("y").alias("hy"))
        near = match.range_join(mine, theirs, [("mx", "hx"), ("my", "hy")], within, keys=[(f"__{s}", s) for s in series]).filter(F.hypot(F.col("mx") - F.col("hx"), F.col("my") - F.col("hy")) < within)
        good = near.groupBy(*series, F.col("__frame").alias("frame")).agg(F.count_distinct("hx", "hy").alias("good"))
        fails = (F.col("state") == "bridged") & (F.coalesce("good", F.lit(0)) < least)
        out = out.join(good, key, "left").withColumns({"m": F.when(~fails, F.col("m")), "state": F.when(fails, "unverified").otherwise(F.col("state"))})
    return out.select(*key, "m", "state")
