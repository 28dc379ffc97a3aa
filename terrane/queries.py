"""The queries of the library's own operators and the SQL that checks them."""

from terrane.plans import decisions, networks, panels, reports

QUERIES = {**panels.QUERIES, **networks.QUERIES, **decisions.QUERIES, **reports.QUERIES}
SQL = {**panels.SQL, **networks.SQL, **decisions.SQL, **reports.SQL}
