"""Fixtures, pipelines and the driver's queries with their SQL."""
