"""Named queries over the test tables, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from geotransfer.queries import (audits, design, features, geography, governance, joining, missing,
                                 modelling, reporting, scans, statistics)
from geotransfer.queries.registry import REGISTRY

__all__ = ["REGISTRY", "audits", "design", "features", "geography", "governance", "joining", "missing",
           "modelling", "reporting", "scans", "statistics"]
