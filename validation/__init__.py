"""Queries over the supplied tables, each with an SQL text that must give the same rows."""
