"""Queries over the given tables, one or more per inventory id, with their SQL.

``domain`` maps the given tables to forecast frames; the other modules register
a query, the columns it returns and, where it can be said in SQL, a statement
for the same result.
"""

from freshet.catalog import (  # noqa: F401
    aggregate_queries,
    calendar_queries,
    explain_queries,
    fold_queries,
    frame_queries,
    join_queries,
    metric_queries,
    model_queries,
    postprocess_queries,
    scalar_queries,
    source_queries,
    window_queries,
)
from freshet.catalog.registry import ENTRIES, Entry  # noqa: F401
