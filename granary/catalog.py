
from __future__ import annotations

from granary.queries import data, datasets, files, logs, quality, reports, scalars, scores, selection, streams

_PARTS = (scores, data, selection, quality, scalars, streams, reports, logs, datasets, files)
QUERIES = {name: f for part in _PARTS for name, f in part.REGISTRY.queries.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.REGISTRY.oracles.items()}
