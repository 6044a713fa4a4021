"""Registered queries and the SQL that they are held against."""

from tidemark.queries import browse, commands, ingest, report, search, stored

PARTS = (browse, search, ingest, report, commands, stored)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
