"""All registered queries and their SQL twins."""

from linetrawl.plans import (
    function_queries, incremental_queries, office_queries, report_queries, scan_queries, search_queries,
    stream_queries,
)

_MODULES = (search_queries, scan_queries, report_queries, incremental_queries, office_queries, function_queries, stream_queries)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in _MODULES for name, q in m.ORACLES.items()}
