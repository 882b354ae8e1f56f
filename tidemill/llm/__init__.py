"""Operators on text corpora. Nothing else in the library imports this package."""

from tidemill.llm import plans

QUERIES, SQL = plans.QUERIES, plans.SQL
