"""Queries that put the operators to work on the driver's tables, each with its SQL."""
