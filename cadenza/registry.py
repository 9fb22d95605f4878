"""Queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import blocks, exchange, joins, library, records, rhythm, scores, series, shared, stores, streams, timeline

QUERIES: dict = {**timeline.QUERIES, **shared.QUERIES, **library.QUERIES, **streams.QUERIES, **scores.QUERIES, **blocks.QUERIES, **stores.QUERIES, **joins.QUERIES, **records.QUERIES, **rhythm.QUERIES, **series.QUERIES, **exchange.QUERIES}
ORACLES: dict = {**timeline.ORACLES, **shared.ORACLES, **library.ORACLES, **streams.ORACLES, **scores.ORACLES, **blocks.ORACLES, **stores.ORACLES, **joins.ORACLES, **records.ORACLES, **rhythm.ORACLES, **series.ORACLES, **exchange.ORACLES}
