"""All queries of the library proper, with their SQL."""

from __future__ import annotations

from . import behaviour, funnel, small, text  # noqa: F401  (each registers its queries)
from .registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "j1_label_join"
