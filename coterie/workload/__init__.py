"""The registered queries. Each reads the given tables whole; most carry an
oracle, the same result as SQL."""

from coterie.workload import (  # noqa: F401  (importing registers)
    clustering,
    profiling,
    recommending,
    relational,
    runs,
    sweeping,
)
from coterie.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
