"""Queries on the given tables, each with SQL for the same rows where SQL can say it."""
