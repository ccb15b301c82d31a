"""CRC-32 as linear algebra over GF(2).

Without its initial and final inversions a CRC is linear: it is the exclusive or
of what each byte contributes, and a byte's contribution depends on the byte and
on how many bytes follow it.  Appending a zero byte is multiplication by a fixed
32 x 32 matrix over GF(2), here held as four tables of 256 (one for each byte of
the register).  Its powers shift a CRC over any length, which is all that is
needed to join the CRCs of two strings without the strings.
"""

from __future__ import annotations

import numpy as np

#: The reflected polynomial of CRC-32 and its register before and after (fixed values).
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
#: Bytes of a word that are looked up with their distance from the end; longer words are cut into pieces of this length.
PIECE = 64


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(POLYNOMIAL), x >> 1)
    return x


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A matrix, as four tables, times registers."""
    out = tables[0][x & 255]
    for k in range(1, 4):
        out ^= tables[k][x >> np.uint32(8 * k) & np.uint32(255)]
    return out


def _tables_of(fn) -> np.ndarray:
    """The four tables of a linear map."""
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([fn(byte << np.uint32(8 * k)) for k in range(4)])


_BYTE = _byte_table()
#: Matrix k appends 2**k zero bytes.
_POWERS = [_tables_of(lambda x: _BYTE[x & 255] ^ (x >> np.uint32(8)))]
for _ in range(39):
    _POWERS.append(_tables_of(lambda x, t=_POWERS[-1]: _apply(t, _apply(t, x))))
#: _AT[d * 256 + b]: what byte b contributes when d bytes follow it.
_AT = np.empty((PIECE, 256), dtype=np.uint32)
_AT[0] = _BYTE
for _d in range(1, PIECE):
    _AT[_d] = _apply(_POWERS[0], _AT[_d - 1])
_AT = _AT.reshape(-1)


def shifted(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers after ``length`` (below 2**40) more zero bytes each."""
    out, rest, k = np.array(x, dtype=np.uint32), np.array(length, dtype=np.int64), 0
    while True:
        at = np.flatnonzero(rest & 1)
        if len(at):
            out[at] = _apply(_POWERS[k], out[at])
        rest >>= 1
        k += 1
        if not rest.any():
            return out


#: What both inversions add to a span of that length.
_INVERTED = shifted(np.full(PIECE + 1, ONES), np.arange(PIECE + 1)) ^ ONES


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of strings put together, from those of their halves and the bytes of the second ones."""
    return shifted(first, length) ^ second


def span_crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of buf[start:end] for each span.

    Spans ascend, none is empty, a byte at least lies between any two, and one
    follows the last.  Each byte of the buffer is looked up once.
    """
    if not len(start):
        return np.zeros(0, dtype=np.uint32)
    length = end - start
    pieces = (length + PIECE - 1) // PIECE
    whole = bool((pieces == 1).all())
    if whole:
        low, high = start, end
    else:  # a longer span is cut from its end
        span = np.repeat(np.arange(len(start)), pieces)
        behind = pieces[span] - 1 - (np.arange(len(span)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        high = end[span] - PIECE * behind
        low = np.maximum(start[span], high - PIECE)
    edges = np.stack((low, high), axis=1).reshape(-1)  # pieces of a span touch, so an edge may come twice
    edges = edges if whole else edges[np.concatenate(([True], edges[1:] != edges[:-1]))]
    following = np.repeat(edges[1:], np.diff(edges)) - 1
    place = np.arange(edges[0], edges[-1])
    given = _AT[(following - place & PIECE - 1) * 256 + buf[edges[0] : edges[-1]]]
    raw = np.bitwise_xor.reduceat(given, edges[:-1] - edges[0])  # of spans and of the gaps between them
    raw = raw[::2] if whole else raw[np.searchsorted(edges, low)]
    if not whole:
        raw = np.bitwise_xor.reduceat(shifted(raw, PIECE * behind), np.cumsum(pieces) - pieces)
    if whole:
        return raw ^ _INVERTED[length]
    distinct, back = np.unique(length, return_inverse=True)
    return raw ^ shifted(np.full(len(distinct), ONES), distinct)[back] ^ ONES
