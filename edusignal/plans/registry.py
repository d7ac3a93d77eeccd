"""Registered queries: one Spark job per survey operator, each with its
independent DuckDB oracle (or ``None`` for rows-only checks).

Every query reads whole tables of the given scale-factor directory through
:class:`edusignal.sources.fixtures.Domain`; no row caps or id subsets.
"""

from __future__ import annotations

from .base import AS_OF, REGISTRY, avg_round, hround, register  # noqa: F401

# Load the query modules (each registers its queries on import).
from . import q_marts  # noqa: E402,F401
from . import q_exercises  # noqa: E402,F401
from . import q_dashboard  # noqa: E402,F401
from . import q_lifecycle  # noqa: E402,F401
from . import q_features  # noqa: E402,F401
from . import q_wide  # noqa: E402,F401
from . import q_evaluation  # noqa: E402,F401
from . import q_events  # noqa: E402,F401
from . import q_models  # noqa: E402,F401
from . import q_misc  # noqa: E402,F401
from . import q_sources  # noqa: E402,F401
