"""All queries of the library: name -> callable and, where SQL can express it, the equivalent SQL."""

from __future__ import annotations

from . import corpus, curation, decisions, pipelines, review, scoring  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "contaminated_documents"
