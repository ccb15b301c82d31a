"""Names, metadata and settings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of files by kind: fixed values.
RAW_SUFFIXES = [".arw", ".cr2", ".cr3", ".dng", ".nef", ".orf", ".pef", ".raf", ".rw2", ".srw"]
IMAGE_SUFFIXES = [".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff"]
FITS_SUFFIXES = [".fit", ".fits", ".fts"]
VIDEO_SUFFIXES = [".avi", ".m4v", ".mkv", ".mov", ".mp4", ".ser"]
#: Parts of file names that speak of calibrated sky series: fixed values.
SKY_NAMES = ["light_", "_light", "dark_", "_dark", "flat_", "bias_", "_sub", "sub_"]
#: Parts of a filter's name that speak of narrow bands: fixed values.
NARROW_BANDS = ["dual", "duo", "extreme", "enhance", "oiii", "o3", "ha+", "ha/", "sho", "hoo", "triband", "tri-band", "narrowband", "schmalband", "alp-t", "alpt", "multi-narrow"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def kind(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(RAW_SUFFIXES), "raw").when(s.isin(IMAGE_SUFFIXES), "image").when(s.isin(FITS_SUFFIXES), "fits").when(s.isin(VIDEO_SUFFIXES), "video").otherwise("other")


def number(text: Column) -> Column:
    """The first number in a text; a ratio is divided."""
    ratio = F.regexp_extract(text, r"^\s*([0-9.]+)\s*/\s*([0-9.]+)", 1), F.regexp_extract(text, r"^\s*([0-9.]+)\s*/\s*([0-9.]+)", 2)
    plain = F.regexp_extract(text, r"[0-9.]+", 0).try_cast("double")
    return F.coalesce(F.try_divide(ratio[0].try_cast("double"), ratio[1].try_cast("double")), plain)


def module_of(paths_have_fits: Column, names_of_sky: Column, exposure: Column, iso: Column) -> Column:
    long = F.coalesce(exposure >= 1.0, F.lit(False)) & (F.coalesce(iso, F.lit(0.0)) >= 1600)
    return F.when(paths_have_fits | names_of_sky, "astro").when(long, "astro").when(F.coalesce(exposure >= 1.5, F.lit(False)), "longexp").otherwise("macro")


def has_sky_name(name: Column) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in SKY_NAMES]), lambda t: F.contains(F.lower(name), t))


def is_narrow_band(name: Column) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in NARROW_BANDS]), lambda t: F.contains(F.lower(name), t))


def version_key(text: Column, parts: int = 4) -> Column:
    """Dotted version as an array of whole numbers, filled with zeros; arrays compare element by element."""
    numbers = F.transform(F.split(F.regexp_replace(text, "[^0-9.]", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), parts)), 1, parts)


def cache_key(path: Column, changed: Column) -> Column:
    return F.md5(F.concat(path, changed.cast("string")))


def least_structure(median_peak: Column) -> Column:
    """The floor under which a frame has no structure: 5 % of the median, 8 to 40."""
    return F.least(F.greatest(median_peak * 0.05, F.lit(8.0)), F.lit(40.0))


def translate(text: Column, dictionary: dict[str, str]) -> Column:
    if not dictionary:
        return text
    table = F.create_map(*[F.lit(x) for pair in dictionary.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), text)
