"""Colour frames from mosaics of single-colour pixels (Bayer patterns)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows

#: Colours of a 2x2 cell, row by row, in the order in which ties are settled (fixed values).
PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")
#: Scores this close to the least one (as a share of it) tie.
TIE = 1e-9
#: Side of the piece in a frame's middle that is tried with each pattern.
CROP = 400


def sites(h: int, w: int, pattern: str) -> np.ndarray:
    """h x w x 3 (b, g, r): whether a pixel measures that channel."""
    yy, xx = np.mgrid[0:h, 0:w]
    colour = np.array(["BGR".index(c) for c in pattern])[yy % 2 * 2 + xx % 2]
    return colour[..., None] == np.arange(3)


def _near(x: np.ndarray) -> np.ndarray:
    """Sums over 3x3 squares, inside the frame."""
    p = np.pad(x, ((1, 1), (1, 1), (0, 0)))
    rows_ = p[:-2] + p[1:-1] + p[2:]
    return rows_[:, :-2] + rows_[:, 1:-1] + rows_[:, 2:]


def debayer(raw: np.ndarray, pattern: str) -> np.ndarray:
    """Each channel where it was measured, elsewhere the mean of its pixels among the eight neighbours (bilinear); b, g, r."""
    own = sites(*raw.shape, pattern)
    known = np.where(own, raw[..., None], 0.0)
    count = _near(own.astype(float))
    return np.where(own, raw[..., None], _near(known) / np.maximum(count, 1))


def artefacts(raw: np.ndarray, pattern: str) -> float:
    """Mean size of the Laplacian of the channels' distances from grey: a wrong pattern makes a chequerboard of colours."""
    colour = debayer(raw, pattern)
    chroma = np.pad(colour - colour.mean(axis=2, keepdims=True), ((1, 1), (1, 1), (0, 0)), mode="reflect" if min(raw.shape) > 1 else "edge")
    around = chroma[:-2, 1:-1] + chroma[2:, 1:-1] + chroma[1:-1, :-2] + chroma[1:-1, 2:]
    return float(np.abs(around - 4 * chroma[1:-1, 1:-1]).mean())


def middle(raw: np.ndarray, side: int = CROP) -> np.ndarray:
    """A square from the middle; it starts on even rows and columns, so patterns keep their phase."""
    s = min(side, min(raw.shape) // 2 * 2)
    top, left = (raw.shape[0] - s) // 4 * 2, (raw.shape[1] - s) // 4 * 2
    return raw[top : top + s, left : left + s] if s else raw


def pattern_scores(frames: DataFrame, series: list[str], side: int = CROP) -> DataFrame:
    """Per series and pattern the summed artefacts of its frames, and whether it is the series' pattern (the least; ties by PATTERNS).

    Red and blue change places between RGGB and BGGR, and between GRBG and GBRG,
    which leaves the artefacts as they are: pixels tell where green is, and only a
    header can tell red from blue.

    ``frames``: series..., h, w, values.  Frames without pixels, and values that are
    no numbers, count as nothing.  Scores are summed, so only four numbers a frame move.
    """

    def kernel(row: dict) -> dict:
        raw = row["values"]
        piece = None if raw is None else middle(np.nan_to_num(raw), side)
        return {"scores": np.array([0.0 if piece is None or not piece.size else artefacts(piece, p) for p in PATTERNS])}

    scores = rows.row_map(frames, series, {"scores": "array<double>"}, kernel)
    total = scores.groupBy(*series).agg(*[F.sum(F.col("scores")[k]).alias(p) for k, p in enumerate(PATTERNS)])
    best = F.least(*PATTERNS) * (1.0 + TIE)
    pick = F.lit(PATTERNS[-1])
    for p in PATTERNS[-2::-1]:
        pick = F.when(F.col(p) <= best, p).otherwise(pick)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(p).alias("score")) for p in PATTERNS])).alias("e")
    return total.withColumn("pick", pick).select(*series, "pick", each).select(*series, "e.pattern", "e.score", (F.col("pick") == F.col("e.pattern")).alias("chosen"))


def debayered(frames: DataFrame, series: list[str], frame: str, header: str | None = None) -> DataFrame:
    """Mosaics (series..., frame, h, w, values) as colour frames: the same with pattern, and values in b, g, r.

    The pattern is that of the column ``header`` where it names one of PATTERNS,
    else the one of least artefacts over all frames of the series.  A row without
    values stays without.  Series' patterns (a row each) meet frames by a join that
    Spark broadcasts or shuffles by their size.
    """
    guess = pattern_scores(frames, series).filter("chosen").select(*series, F.col("pattern").alias("guess"))
    told = F.upper(F.trim(F.col(header))) if header else F.lit(None).cast("string")
    named = frames.withColumn("pattern", F.when(told.isin(*PATTERNS), told)).join(guess, series, "left").withColumn("pattern", F.coalesce("pattern", "guess"))
    keep = [*series, frame, "h", "w", "pattern"]
    return rows.row_map(named, keep, {"values": "array<double>"}, lambda r: {"values": None if r["values"] is None or r["pattern"] is None else debayer(np.nan_to_num(r["values"]), r["pattern"])})
