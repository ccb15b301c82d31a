"""Colour spaces, palettes and masks as column expressions; channel order is b, g, r."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import clip, smoothstep

#: Linear RGB to XYZ (D65; ProPhoto D50) and Bradford adaptation: fixed values of the colour spaces.
RGB_TO_XYZ = {
    "srgb": [[0.4123908, 0.3575843, 0.1804808], [0.2126390, 0.7151687, 0.0721923], [0.0193308, 0.1191948, 0.9505322]],
    "rec2020": [[0.6369580, 0.1446169, 0.1688810], [0.2627002, 0.6779981, 0.0593017], [0.0, 0.0280727, 1.0609851]],
    "prophoto": [[0.7976749, 0.1351917, 0.0313534], [0.2880402, 0.7118741, 0.0000857], [0.0, 0.0, 0.8252100]],
}
D65_TO_D50 = [[1.0478112, 0.0228866, -0.0501270], [0.0295424, 0.9904844, -0.0170491], [-0.0092345, 0.0150436, 0.7521316]]
#: Hue centres of the eight colour bands, in degrees.
HUE_BANDS = {"red": 0, "orange": 30, "yellow": 60, "green": 120, "aqua": 180, "blue": 240, "purple": 270, "magenta": 300}


def multiply(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def inverse(m: list[list[float]]) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [
        [(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det],
        [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det],
        [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det],
    ]


def _space(name: str) -> list[list[float]]:
    if name not in RGB_TO_XYZ:
        raise ValueError(f"unknown working space {name!r}; known: {sorted(RGB_TO_XYZ)}")
    return RGB_TO_XYZ[name]


def apply_matrix(m: list[list[float]], channels: list[Column]) -> list[Column]:
    return [m[i][0] * channels[0] + m[i][1] * channels[1] + m[i][2] * channels[2] for i in range(3)]


def xyz_to_working(xyz: list[Column], working: str = "rec2020") -> list[Column]:
    m = inverse(_space(working))
    return apply_matrix(multiply(m, D65_TO_D50) if working == "prophoto" else m, xyz)


def camera_to_working(rgb: list[Column], camera: list[list[float]], working: str = "rec2020") -> list[Column]:
    """Linear camera RGB by the matrix XYZ -> camera; a fourth row is left out."""
    to_xyz = inverse(camera[:3])
    if working == "prophoto":
        to_xyz = multiply(D65_TO_D50, to_xyz)
    return apply_matrix(multiply(inverse(_space(working)), to_xyz), rgb)


def working_to_srgb(rgb: list[Column], working: str = "rec2020") -> list[Column]:
    to_xyz = _space(working)
    if working == "prophoto":
        to_xyz = multiply(inverse(D65_TO_D50), to_xyz)
    return apply_matrix(multiply(inverse(RGB_TO_XYZ["srgb"]), to_xyz), rgb)


def gray(b: Column, g: Column, r: Column) -> Column:
    return (b + g + r) / 3.0


def luminance(b: Column, g: Column, r: Column) -> Column:
    return 0.0722 * b + 0.7152 * g + 0.2126 * r


def hue(b: Column, g: Column, r: Column) -> Column:
    """0 to 1; 0 for grey."""
    top, span = F.greatest(b, g, r), F.greatest(b, g, r) - F.least(b, g, r)
    safe = F.when(span > 0, span).otherwise(1.0)
    h = F.when(top == r, (g - b) / safe).when(top == g, 2.0 + (b - r) / safe).otherwise(4.0 + (r - g) / safe) / 6.0
    return F.when(span <= 0, 0.0).when(h < 0, h + 1.0).otherwise(h)


def saturation(b: Column, g: Column, r: Column) -> Column:
    top = F.greatest(b, g, r)
    return F.when(top > 0, (top - F.least(b, g, r)) / F.when(top > 0, top).otherwise(1.0)).otherwise(0.0)


def saturate(channels: list[Column], amount: float) -> list[Column]:
    lum = gray(*channels)
    return [clip(lum + (c - lum) * amount) for c in channels]


def remove_green(b: Column, g: Column, r: Column, amount: float = 1.0) -> Column:
    return g * (1.0 - amount) + F.least(g, (b + r) * 0.5) * amount


def band_mask(v: Column, low: float, high: float, feather: float = 0.1) -> Column:
    low, high = min(low, high), max(low, high)
    feather = max(feather, 1e-4)
    return clip(smoothstep(low - feather, low, v) * (1.0 - smoothstep(high, high + feather, v)))


def hue_band(h: Column) -> Column:
    """The band of HUE_BANDS whose centre is nearest around the circle (hue in 0 to 1); of equal distances the first."""
    apart = lambda centre: F.least(F.abs(h * 360.0 - centre), 360.0 - F.abs(h * 360.0 - centre))
    nearest = F.array_min(F.array(*[F.struct(F.round(apart(float(c)), 9).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(HUE_BANDS.values())]))
    return F.element_at(F.array(*map(F.lit, HUE_BANDS)), nearest["k"] + 1)


def hue_mask(h: Column, low: float, high: float, feather: float = 0.1) -> Column:
    """Around the circle, also over 1.0."""
    low, high, feather = low % 1.0, high % 1.0, max(feather, 1e-4)
    over = high < low
    centre, half = ((low + high + over) / 2.0) % 1.0, (high + over - low) / 2.0
    d = F.abs(h - centre)
    return clip(1.0 - smoothstep(half, half + feather, F.least(d, 1.0 - d)))


def parametric_mask(b: Column, g: Column, r: Column, by: str = "luminance", low: float = 0.0, high: float = 1.0, feather: float = 0.1) -> Column:
    b, g, r = (clip(c) for c in (b, g, r))
    if by == "luminance":
        return band_mask(luminance(b, g, r), low, high, feather)
    if by == "saturation":
        return band_mask(saturation(b, g, r), low, high, feather)
    if by == "hue":
        return hue_mask(hue(b, g, r), low, high, feather)
    raise ValueError(f"unknown property {by!r}; known: luminance, hue, saturation")


def gradient_mask(x: Column, y: Column, height: int, width: int, cx: float, cy: float, angle: float, feather: float = 0.3) -> Column:
    import math

    a, half = math.radians(angle), feather * math.hypot(height, width) / 2
    return smoothstep(-half, half, (x - cx) * math.cos(a) + (y - cy) * math.sin(a))


def radial_mask(x: Column, y: Column, cx: float, cy: float, rx: float, ry: float, feather: float = 0.3) -> Column:
    dx, dy = (x - cx) / max(rx, 1e-6), (y - cy) / max(ry, 1e-6)
    return 1.0 - smoothstep(1.0 - feather, 1.0, F.sqrt(dx * dx + dy * dy))


def two_lines(df: DataFrame, series: list[str], unmix: float = 0.2) -> DataFrame:
    """Adds ha and oiii: red and blue over their 30 % quantile, unmixed, by their 99.9 % quantile."""
    low = df.groupBy(*series).agg(F.expr("percentile(r, 0.3D)").alias("__r"), F.expr("percentile(b, 0.3D)").alias("__b"))
    out = df.join(low, series)
    red, blue = F.greatest(F.col("r") - F.col("__r"), F.lit(0.0)), F.greatest(F.col("b") - F.col("__b"), F.lit(0.0))
    out = out.withColumns({"__h": F.greatest(red - unmix * blue, F.lit(0.0)), "__o": F.greatest(blue - unmix * red, F.lit(0.0))})
    top = out.groupBy(*series).agg(F.expr("percentile(__h, 0.999D)").alias("__ht"), F.expr("percentile(__o, 0.999D)").alias("__ot"))
    part = lambda x, t: clip(F.col(x) / F.greatest(F.col(t), F.lit(1e-6)))
    return out.join(top, series).withColumns({"ha": part("__h", "__ht"), "oiii": part("__o", "__ot")}).drop("__r", "__b", "__h", "__o", "__ht", "__ot")


def palette(name: str, ha: Column, oiii: Column) -> list[Column]:
    """(b, g, r) of a narrow-band palette."""
    if name == "hoo":
        green = oiii
    elif name == "sho":
        green = clip(0.8 * ha + 0.2 * oiii)
    elif name == "foraxx":
        p = clip(ha * oiii, 1e-6, 1.0)
        f = F.pow(p, 1.0 - p)
        green = clip(f * ha + (1.0 - f) * oiii)
    elif name == "bicolor":
        green = clip(F.greatest(oiii, 0.5 * ha))
    else:
        raise ValueError(f"unknown palette {name!r}; known: hoo, sho, foraxx, bicolor")
    return [oiii, green, ha]


def color_balance(df: DataFrame, series: list[str]) -> DataFrame:
    """Each channel's 30 % quantile goes to a common pedestal, its 99.5 % quantile to their mean (scale 0.4 to 2.5)."""
    low = df.groupBy(*series).agg(*[F.expr(f"percentile({c}, 0.3D)").alias(f"__{c}") for c in "bgr"])
    out = df.join(low, series)
    base = F.least("__b", "__g", "__r") * 0.1
    out = out.withColumns({c: F.greatest(F.col(c) - (F.col(f"__{c}") - base), F.lit(0.0)) for c in "bgr"}).drop("__b", "__g", "__r")
    high = out.groupBy(*series).agg(*[F.expr(f"percentile({c}, 0.995D)").alias(f"__{c}") for c in "bgr"])
    out = out.join(high, series)
    mean = (F.col("__b") + F.col("__g") + F.col("__r")) / 3.0
    return out.withColumns({c: F.col(c) * clip(mean / F.greatest(F.col(f"__{c}"), F.lit(1e-6)), 0.4, 2.5) for c in "bgr"}).drop("__b", "__g", "__r")


def neutralize(df: DataFrame, series: list[str], share: float = 0.25) -> DataFrame:
    """Each channel's low percentile goes to the least of them."""
    low = df.groupBy(*series).agg(*[F.expr(f"percentile({c}, {share}D)").alias(f"__{c}") for c in "bgr"])
    out = df.join(low, series)
    target = F.least("__b", "__g", "__r")
    return out.withColumns({c: F.greatest(F.col(c) - (F.col(f"__{c}") - target), F.lit(0.0)) for c in "bgr"}).drop("__b", "__g", "__r")


def white_balance(df: DataFrame, series: list[str], strength: float = 0.6, least: int = 50) -> DataFrame:
    """Grey-world gains and those of the brightest 5 %, as a geometric mean, cut to 0.7..1.4 and blended in."""
    lum = 0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r")
    df = df.withColumn("__l", lum)
    means = df.groupBy(*series).agg(F.expr("percentile(__l, 0.95D)").alias("__cut"), *[(F.avg(c) + 1e-6).alias(f"__{c}") for c in "bgr"])
    joined = df.join(means, series)
    top = joined.filter("__l >= __cut").groupBy(*series).agg(F.count(F.lit(1)).alias("__n"), *[(F.avg(c) + 1e-6).alias(f"__h{c}") for c in "bgr"])
    joined = joined.join(top, series)

    def gain(c: str) -> Column:
        world = (F.col("__b") + F.col("__g") + F.col("__r")) / 3.0 / F.col(f"__{c}")
        anchor = (F.col("__hb") + F.col("__hg") + F.col("__hr")) / 3.0 / F.col(f"__h{c}")
        g = F.when(F.col("__n") > least, F.sqrt(world * anchor)).otherwise(world)
        return 1.0 + strength * (clip(g, 0.7, 1.4) - 1.0)

    return joined.select(*[c for c in df.columns if c not in ("b", "g", "r", "__l")], *[clip(F.col(c) * gain(c)).alias(c) for c in "bgr"])


def edit(b: Column, g: Column, r: Column, exposure: float = 0.0, temperature: float = 0.0, contrast: float = 0.0, vividness: float = 0.0) -> list[Column]:
    """Ordered pointwise edits, amounts from -100 to 100: exposure 2 ** (e / 100), temperature, contrast around the middle, saturation."""
    scale = 2.0 ** (exposure / 100.0)
    t = temperature / 100.0 * 0.3
    out = [clip(b * scale * (1.0 - t)), clip(g * scale), clip(r * scale * (1.0 + t))]
    out = [clip((c - 0.5) * (1.0 + contrast / 100.0) + 0.5) for c in out]
    return saturate(out, 1.0 + vividness / 100.0)
