"""All named queries of the core."""

from __future__ import annotations

from ledgerleaf.plans import geometry, retrieval, sections, texts  # noqa: F401  (they register their queries)
from ledgerleaf.plans.common import ORACLES, QUERIES  # noqa: F401
