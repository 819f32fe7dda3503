"""Composite reports, the queries over the test tables, and their SQL."""
