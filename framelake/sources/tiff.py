"""TIFF files of 8 and 16 bits: pages in strips, plain or deflated, with or without horizontal differences."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Tags and their kinds (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339
_KINDS = {1: "B", 3: "H", 4: "I"}
NONE, DEFLATE = 1, 8
_DEFLATES = (8, 32946)
#: Bytes of a strip before compression, about.
STRIP_SIZE = 1 << 16


def _tags(content: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """A directory's whole-number tags, and where the next one lies (0: nowhere)."""
    count = struct.unpack_from(order + "H", content, at)[0]
    out = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
        if kind not in _KINDS:
            continue
        form = order + str(n) + _KINDS[kind]
        place = at + 10 + 12 * k
        out[tag] = struct.unpack_from(form, content, place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", content, place)[0])
    return out, struct.unpack_from(order + "I", content, at + 2 + 12 * count)[0]


def _page(content: bytes, tags: dict[int, tuple], order: str) -> np.ndarray:
    one = lambda tag, default=None: tags[tag][0] if default is None else tags.get(tag, (default,))[0]
    h, w, samples, bits = one(HEIGHT), one(WIDTH), one(SAMPLES, 1), tags.get(BITS, (1,))
    if set(bits) - {8} and set(bits) - {16} or one(SAMPLE_FORMAT, 1) != 1 or one(PLANAR, 1) != 1:
        raise ValueError("only whole numbers of 8 or 16 bits, samples side by side")
    if one(COMPRESSION, NONE) not in (NONE, *_DEFLATES) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only plain or deflated strips")
    kind = np.dtype(order + f"u{bits[0] // 8}")
    rows, step = [], one(STRIP_ROWS, h)
    for k, (at, size) in enumerate(zip(tags[STRIPS], tags[STRIP_BYTES])):
        raw = content[at : at + size]
        if one(COMPRESSION, NONE) != NONE:
            raw = zlib.decompress(raw)
        here = min(step, h - k * step)
        strip = np.frombuffer(raw, dtype=kind, count=here * w * samples).reshape(here, w, samples)
        if one(PREDICTOR, 1) == 2:
            strip = np.cumsum(strip, axis=1, dtype=kind.newbyteorder("="))
        rows.append(strip)
    out = np.concatenate(rows) if rows else np.zeros((0, w, samples))
    if len(out) != h:
        raise ValueError("strips are missing")
    out = out.astype(kind.newbyteorder("="))
    return np.iinfo(out.dtype).max - out if one(PHOTOMETRIC, 1) == 0 else out


def decode(content: bytes) -> list[np.ndarray]:
    """Pages (h x w x samples, unsigned of 8 or 16 bits); ValueError or struct.error for what this reader can't read."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise ValueError("no TIFF file")
    at, seen, pages = struct.unpack_from(order + "I", content, 4)[0], set(), []
    while at and at not in seen:
        seen.add(at)
        tags, following = _tags(content, at, order)
        try:
            pages.append(_page(content, tags, order))
        except (KeyError, zlib.error) as e:
            raise ValueError(f"damaged page: {e}") from e
        at = following
    return pages


def encode(pages: list[np.ndarray], deflate: bool = True) -> bytes:
    """Pages of 8 or 16 bits as a little-endian file; deflated strips hold differences of neighbours."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        page = page[..., None] if page.ndim == 2 else page
        if page.dtype not in (np.uint8, np.uint16):
            raise ValueError("pages are uint8 or uint16")
        h, w, samples = page.shape
        data = page.astype(page.dtype.newbyteorder("<"))
        step = max(1, STRIP_SIZE // max(1, w * samples * page.itemsize))
        strips, sizes = [], []
        for top in range(0, h, step):
            strip = data[top : top + step]
            if deflate:
                strip = np.concatenate((strip[:, :1], np.diff(strip, axis=1)), axis=1).astype(data.dtype)
            raw = strip.tobytes()
            raw = zlib.compress(raw, 6) if deflate else raw
            strips.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        entries = [
            (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8 * page.itemsize] * samples), (COMPRESSION, 3, [DEFLATE if deflate else NONE]), (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]),
            (STRIPS, 4, strips), (SAMPLES, 3, [samples]), (STRIP_ROWS, 4, [step]), (STRIP_BYTES, 4, sizes), (PLANAR, 3, [1]), (PREDICTOR, 3, [2 if deflate else 1]),
        ]
        fields = []
        for tag, kind, values in entries:
            raw = struct.pack(f"<{len(values)}{_KINDS[kind]}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", place)
            fields.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
