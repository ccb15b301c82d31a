"""Straight trails of satellites and aircraft, by votes of bright pixels for lines (Hough)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches

#: Added before votes are rounded, so that distances half way between two bins fall the same way everywhere.
NUDGE = 1e-9


def bright_pixels(px: DataFrame, frame: list[str], factor: float = 4.0, value: str = "v") -> DataFrame:
    """frame..., y, x of pixels more than ``factor`` standard deviations above their frame's median."""
    cut = px.groupBy(*frame).agg((F.median(value) + factor * (F.stddev_pop(value) + 1e-6)).alias("__cut"))
    return px.join(cut, frame).filter(F.col(value) > F.col("__cut")).select(*frame, "y", "x")


def lines(bright: DataFrame, frame: list[str], least_votes: int, least_length: float, most_gap: float = 8.0, angles: int = 180) -> DataFrame:
    """Line segments of bright pixels: frame..., angle (steps of 180 / angles degrees), rho, votes, length.

    Every pixel votes for the line through it at each angle.  Pixels of lines with
    enough votes are then put in order along the line and cut where the gap is too
    wide; pieces long enough are returned.  A task holds the bright pixels of a
    bounded batch of frames, a frame's at least, and goes through them angle by angle: votes
    are neither stored nor shuffled.  Unlike a sampled transform, all pixels vote and the result is fixed.
    """
    bounded_batches(bright.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in bright.schema}
    schema = ", ".join(f"`{f}` {kinds[f]}" for f in frame) + ", angle int, rho bigint, votes bigint, length double"
    packed = bright.groupBy(*frame).agg(F.collect_list(F.struct(F.col("y").cast("double"), F.col("x").cast("double"))).alias("__at"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x = (a.to_numpy() for a in batch.column("__at").flatten().flatten())
            of = np.repeat(np.arange(batch.num_rows), batch.column("__at").value_lengths().to_numpy())
            found = []
            for angle in range(angles):
                turn = np.radians(angle * (180.0 / angles))
                cos, sin = np.cos(turn), np.sin(turn)
                rho = np.floor(x * cos + y * sin + 0.5 + NUDGE).astype(np.int64)
                low, span = rho.min(), np.ptp(rho) + 1
                line = of * span + (rho - low)
                _, at, count = np.unique(line, return_inverse=True, return_counts=True)
                votes = count[at]
                on = np.flatnonzero(votes >= least_votes)
                if not len(on):
                    continue
                along = y[on] * cos - x[on] * sin
                order = np.lexsort((along, line[on]))
                on, along = on[order], along[order]
                first = np.flatnonzero(np.append(True, (np.diff(line[on]) != 0) | (np.diff(along) > most_gap)))
                length = along[np.append(first[1:], len(on)) - 1] - along[first]
                kept = length >= least_length - NUDGE
                one = on[first[kept]]
                found.append((of[one], np.full(len(one), angle, dtype=np.int32), rho[one], votes[one], length[kept]))
            if found:
                at, *columns = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([*(batch.column(f).take(pa.array(at)) for f in frame), *map(pa.array, columns)], names=[*frame, "angle", "rho", "votes", "length"])

    return packed.mapInArrow(run, schema)


def detect_trails(px: DataFrame, frame: list[str], factor: float = 4.0, least_votes: int = 60, share: float = 0.3, most_gap: float = 8.0, value: str = "v") -> DataFrame:
    """frame..., trail: whether a line of bright pixels runs over ``share`` of the frame's long side; every frame of ``px`` has a row.

    Frames may differ in size: the least length is that of the longest side of all,
    so give frames of one size.  An empty table gives no rows; frames of equal values
    have no bright pixels.
    """
    side = px.agg(F.greatest(F.max("y"), F.max("x")).alias("side")).first()["side"]
    found = lines(bright_pixels(px, frame, factor, value), frame, least_votes, share * ((side or 0) + 1), most_gap)
    marked = found.select(*frame).distinct().withColumn("trail", F.lit(True))
    return px.select(*frame).distinct().join(marked, frame, "left").withColumn("trail", F.coalesce("trail", F.lit(False)))
