"""Detail and colour of frames that come as array rows: bands of detail shrunk or raised, stars made neutral, looks.

Lightness and colour are kept apart in CIE Lab, scaled so that lightness is in
[0, 1].  A band is what one Gaussian blur takes away from the one before it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from . import kernels, rows, stars

#: sRGB in linear light to XYZ over its white, b, g, r; Lab's linear end and slope: fixed values of the colour spaces.
TO_XYZ = np.array([[0.1804808, 0.3575843, 0.4123908], [0.0721923, 0.7151687, 0.2126390], [0.9505322, 0.1191948, 0.0193308]])
TO_XYZ = TO_XYZ / TO_XYZ.sum(axis=1, keepdims=True)
FROM_XYZ = np.linalg.inv(TO_XYZ)
LAB_END, LAB_SLOPE = (6 / 29) ** 3, (29 / 6) ** 2 / 3
#: Size of a and b that counts as 1.
CHROMA = 128.0
#: Looks: black point, steepness, clarity, saturation (fixed values).
LOOKS = {"neutral": (0.0, 0.0, 0.0, 1.0), "natural": (0.02, 4.0, 0.2, 1.1), "vivid": (0.03, 5.0, 0.32, 1.22), "dramatic": (0.045, 6.0, 0.45, 1.3)}
#: Noise of a frame at ISO 100, as a share of the range.
NOISE = 0.02


def to_lab(f: np.ndarray) -> np.ndarray:
    """b, g, r in [0, 1] as lightness in [0, 1] and a, b over CHROMA."""
    linear = np.where(f <= 0.04045, f / 12.92, ((np.maximum(f, 0) + 0.055) / 1.055) ** 2.4)
    t = linear @ TO_XYZ.T
    root = np.where(t > LAB_END, np.cbrt(t), LAB_SLOPE * t + 4 / 29)
    x, y, z = np.moveaxis(root, 2, 0)
    return np.stack((1.16 * y - 0.16, 500 * (x - y) / CHROMA, 200 * (y - z) / CHROMA), axis=2)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """The way back, cut to [0, 1]."""
    y = (lab[..., 0] + 0.16) / 1.16
    root = np.stack((y + lab[..., 1] * CHROMA / 500, y, y - lab[..., 2] * CHROMA / 200), axis=2)
    linear = np.where(root > 6 / 29, root**3, (root - 4 / 29) / LAB_SLOPE) @ FROM_XYZ.T
    return np.clip(np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * np.maximum(linear, 0.0031308) ** (1 / 2.4) - 0.055), 0, 1)


def rebanded(x: np.ndarray, scales: int, sigma: float, change: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """``x`` with each of its bands (0 is the finest; blurs double from ``sigma`` on) changed, on the coarsest blur."""
    out = np.zeros_like(x)
    for k in range(scales):
        soft = kernels.blur(x, sigma * 2**k)
        out, x = out + change(k, x - soft), soft
    return out + x


def quiet(x: np.ndarray, threshold: float, scales: int = 4) -> np.ndarray:
    """Bands shrunk towards 0 by a threshold that halves from band to band: noise is fine, edges are strong."""
    return rebanded(x, scales, 1.0, lambda k, band: band - np.clip(band, -threshold / 2**k, threshold / 2**k))


def lively(x: np.ndarray, amount: float, scales: int = 4, protect: float = 0.2) -> np.ndarray:
    """Bands raised by ``amount``, coarser ones less (0.6 from band to band); towards black and white the change fades to ``protect``."""
    change = rebanded(x, scales, 2.0, lambda k, band: band * (1 + amount * 0.6**k)) - x
    share = np.clip(1 - 2 * np.abs(x - 0.5), protect, 1) if protect > 0 else 1.0
    return np.clip(x + share * change, 0, 1)


def on_lightness(f: np.ndarray, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A change of lightness alone; of a grey frame, of its values."""
    if f.ndim == 2:
        return np.clip(change(f), 0, 1)
    lab = to_lab(f)
    lab[..., 0] = change(lab[..., 0])
    return from_lab(lab)


def denoised(f: np.ndarray, luma: float = 1.0, chroma: float = 1.0, iso: float | None = None, scales: int = 4) -> np.ndarray:
    """Lightness and colours freed of noise separately; the threshold grows with the root of ``iso`` over 100."""
    threshold = NOISE * np.sqrt(max(iso or 100.0, 100.0) / 100.0)
    if f.ndim == 2:
        return np.clip(quiet(f, threshold * luma, scales), 0, 1)
    lab = to_lab(f)
    for c, strength in enumerate((luma, chroma, chroma)):
        lab[..., c] = quiet(lab[..., c], threshold * strength, scales)
    return from_lab(lab)


def look(f: np.ndarray, preset: str = "natural") -> np.ndarray:
    """A black point, an S-curve through 0 and 1, clarity (a wide unsharp mask), and saturation by LOOKS."""
    if preset not in LOOKS:
        raise ValueError(f"looks are {sorted(LOOKS)}")
    black, steep, clarity, saturation = LOOKS[preset]
    if preset == "neutral":
        return f.copy()
    lab = to_lab(f)
    light = np.clip((lab[..., 0] - black) / (1 - black), 0, 1)
    light = 0.5 + np.tanh(steep / 2 * (light - 0.5)) / (2 * np.tanh(steep / 4))  # the logistic curve, pinned at both ends
    light = np.clip(light + clarity * (light - kernels.blur(light, max(3.0, min(light.shape) / 50.0))), 0, 1)
    return from_lab(np.stack((light, lab[..., 1] * saturation, lab[..., 2] * saturation), axis=2))


def star_share(f: np.ndarray, grow: int = 4, soft: float = 2.0) -> np.ndarray:
    """How much of each pixel belongs to a star: stars of the brightest channel with their halos, softly."""
    mask = stars.detect(f.max(axis=2))[1].astype(float)
    return np.clip(kernels.blur(np.lib.stride_tricks.sliding_window_view(np.pad(mask, grow), (2 * grow + 1,) * 2).max(axis=(2, 3)), soft), 0, 1)


def white_stars(f: np.ndarray, strength: float = 0.92) -> np.ndarray:
    """Stars without colour; nebulae keep theirs."""
    share = strength * star_share(f)[..., None]
    return np.clip(f + share * (f.mean(axis=2, keepdims=True) - f), 0, 1)


def star_colour(f: np.ndarray, most: int = 300, least: int = 15) -> tuple[np.ndarray, np.ndarray] | None:
    """(background, gains) of b, g, r that make the median star grey; None with fewer than ``least`` stars that don't saturate."""
    ground = np.quantile(f, 0.3, axis=(0, 1))
    rest = np.clip(f - ground, 0, None)
    found = stars.detect(rest.mean(axis=2), least_area=3)[0]
    colours = []
    for x, y in zip(np.rint(found["x"]).astype(int)[:most], np.rint(found["y"]).astype(int)[:most]):
        patch = rest[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]
        if patch.shape == (5, 5, 3) and 0.02 < patch.max() < 0.95:
            colours.append(patch.mean(axis=(0, 1)))
    if len(colours) < least:
        return None
    middle = np.median(colours, axis=0) + 1e-6
    return ground, np.clip(middle.mean() / middle, 0.4, 2.5)


def balanced(f: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Colours by the frame's own stars, which are white on the whole; a frame with too few keeps its colours."""
    found = star_colour(f)
    if found is None:
        return f.copy()
    ground, gains = found
    share = min(1.0, max(0.0, strength))
    return f + share * (np.clip(f - ground, 0, None) * gains - f)


def tone_map(frames: DataFrame, keep: list[str], change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keep..., h, w, values with ``change`` done to every frame; a frame without values stays without.  Nothing is shuffled."""
    kernel = lambda row: {"values": None if row["values"] is None else change(row["values"])}
    return rows.row_map(frames, [*dict.fromkeys([*keep, "h", "w"])], {"values": "array<double>"}, kernel)
