"""All queries of the library outside the corpus subpackage, and their SQL."""

from quillcast.plans import catalog, queries_clean, queries_forecast, queries_join, queries_predict  # noqa: F401  they register their queries

QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE
