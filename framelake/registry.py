"""All registered queries of the library and their SQL."""

from __future__ import annotations

from .plans import alignment, develop, frames, fusion, neighbourhoods, records, runs, sensor, sky, tone, tones  # noqa: F401  importing them registers their queries


def queries() -> dict:
    return dict(frames.QUERIES)


def oracle_sql() -> dict:
    return dict(frames.SQL)
