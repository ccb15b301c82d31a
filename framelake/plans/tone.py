"""Queries on bands of detail; SQL over the frames' Gaussian bands."""

from __future__ import annotations

from ..operators import rows, tone
from ..sources import tables
from . import kernel_sql as k
from .frames import FRAME, query, rounded


def _mapped(spark, d, change):
    return rounded(rows.pixels(tone.tone_map(tables.array_frames(spark, d), FRAME, change), FRAME, ["value"]), "value")


def _bands(sigmas: tuple[float, ...]) -> list[str]:
    """Bands w0, w1, ... and the last blur s{n}."""
    out, before = [], "u"
    for n, sigma in enumerate(sigmas):
        out += [k.weights(f"g{n}", k.gauss(sigma, round(3 * sigma))), k.apply(f"s{n + 1}", before, f"g{n}"), k.pixelwise(f"w{n}", "a.v - b.v", before, f"s{n + 1}")]
        before = f"s{n + 1}"
    return out


@query("band_denoise", k.statement(k.UNIT, *_bands((1.0, 2.0)), k.pixelwise("o", k.clip("(a.v - least(greatest(a.v, -0.02), 0.02)) + (b.v - least(greatest(b.v, -0.01), 0.01)) + c.v"), "w0", "w1", "s2"), last=k._frames("o")))
def band_denoise(spark, d):
    """Two bands of every frame shrunk towards 0."""
    return _mapped(spark, d, lambda f: tone.denoised(f, scales=2))


@query("band_contrast", k.statement(k.UNIT, *_bands((2.0,)), k.pixelwise("o", k.clip("a.v + least(greatest(1 - 2 * abs(a.v - 0.5), 0.2), 1) * 0.5 * b.v"), "u", "w0"), last=k._frames("o")))
def band_contrast(spark, d):
    """The finest band of every frame raised by half, less towards black and white."""
    return _mapped(spark, d, lambda f: tone.on_lightness(f, lambda x: tone.lively(x, 0.5, 1)))
