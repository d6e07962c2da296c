"""All registered queries and their DuckDB counterparts."""

from workload import history, reports, texts

QUERIES = {**history.QUERIES, **reports.QUERIES, **texts.QUERIES}
ORACLE = {**history.ORACLE, **reports.ORACLE, **texts.ORACLE}
