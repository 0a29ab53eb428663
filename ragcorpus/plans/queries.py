"""All registered queries of the retrieval-corpus operators, and their SQL."""

from ragcorpus.plans import answers, pages, retrieval  # noqa: F401 - they register their queries
from ragcorpus.plans.tables import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
