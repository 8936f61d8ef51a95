"""All queries of the library by name, with their oracles."""

from quaystat.operators import catalogue, contracted, described, gold, governance, indexed, pipeline, published, search, semantic, warehouse
from quaystat.plans import crossed, extended
from quaystat.plans import queries as plans

_PARTS = (plans, extended, crossed, pipeline, semantic, governance, gold, catalogue, search, indexed, warehouse, contracted, published, described)


def _merged(parts: list[dict]) -> dict:
    out: dict = {}
    for part in parts:
        if twice := out.keys() & part.keys():
            raise ValueError(f"defined twice: {', '.join(sorted(twice))}")
        out |= part
    return out


QUERIES: dict = _merged([p.QUERIES for p in _PARTS])
ORACLES: dict = _merged([p.SQL if p in (plans, extended, crossed) else p.ORACLES for p in _PARTS])
