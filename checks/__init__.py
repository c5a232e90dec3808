"""Queries over the given test tables and the SQL that gives the same results."""
