"""World coordinates: the tangent-plane (gnomonic) projection between pixels and the sky, as column expressions.

A frame's row carries crval1, crval2 (the sky at the reference pixel, degrees), crpix1,
crpix2 (that pixel, counted from 1) and cd11, cd12, cd21, cd22 (degrees a pixel).
Pixels x, y count from 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CARDS = ("crval1", "crval2", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")


def wcs_of(header: dict[str, str]) -> dict[str, float] | None:
    """The projection that FITS cards describe; None where they describe no tangent plane on the sky.

    Scales come from CDi_j, or from CDELTi with PCi_j or CROTA2.
    """

    def number(card: str, default: float | None = None) -> float | None:
        try:
            return float(header.get(card, default))
        except (TypeError, ValueError):
            return default

    kinds = [str(header.get(c, "")).strip().upper() for c in ("CTYPE1", "CTYPE2")]
    if not (kinds[0].startswith("RA---TAN") and kinds[1].startswith("DEC--TAN")):
        return None
    out = {c: number(c.upper()) for c in CARDS[:4]}
    if any(f"CD{i}_{j}" in header for i in (1, 2) for j in (1, 2)):
        cd = [number(f"CD{i}_{j}", 0.0) for i in (1, 2) for j in (1, 2)]
    else:
        step = [number("CDELT1"), number("CDELT2")]
        if None in step:
            return None
        turn = math.radians(number("CROTA2", 0.0))
        plain = [math.cos(turn), -math.sin(turn) * step[1] / step[0] if step[0] else 0.0, math.sin(turn) * step[0] / step[1] if step[1] else 0.0, math.cos(turn)]
        pc = [number(f"PC{i}_{j}", float(i == j)) for i in (1, 2) for j in (1, 2)] if any(f"PC{i}_{j}" in header for i in (1, 2) for j in (1, 2)) else plain
        cd = [step[0] * pc[0], step[0] * pc[1], step[1] * pc[2], step[1] * pc[3]]
    out |= dict(zip(CARDS[4:], cd))
    if None in out.values() or abs(out["cd11"] * out["cd22"] - out["cd12"] * out["cd21"]) < 1e-30:
        return None
    return out


def to_sky(x: Column, y: Column) -> tuple[Column, Column]:
    """ra in [0, 360) and dec of a pixel."""
    u, v = x + 1.0 - F.col("crpix1"), y + 1.0 - F.col("crpix2")
    xi, eta = F.radians(F.col("cd11") * u + F.col("cd12") * v), F.radians(F.col("cd21") * u + F.col("cd22") * v)
    d0 = F.radians("crval2")
    below = F.cos(d0) - eta * F.sin(d0)
    ra = F.pmod(F.col("crval1") + F.degrees(F.atan2(xi, below)), F.lit(360.0))
    return ra, F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + below * below)))


def to_pixel(ra: Column, dec: Column) -> tuple[Column, Column]:
    """x and y of a place on the sky; null on the far half of it."""
    turn, d, d0 = F.radians(ra - F.col("crval1")), F.radians(dec), F.radians("crval2")
    depth = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(turn)
    xi = F.degrees(F.cos(d) * F.sin(turn) / depth)
    eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(turn)) / depth)
    whole = F.col("cd11") * F.col("cd22") - F.col("cd12") * F.col("cd21")
    x = (F.col("cd22") * xi - F.col("cd12") * eta) / whole + F.col("crpix1") - 1.0
    y = (F.col("cd11") * eta - F.col("cd21") * xi) / whole + F.col("crpix2") - 1.0
    front = depth > 1e-9
    return F.when(front, x), F.when(front, y)


def direction(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """The unit vector of a place: without seams at 0 degrees or at the poles."""
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)
