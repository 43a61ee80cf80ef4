"""Semantic models, structured queries and the end-to-end pipeline."""
