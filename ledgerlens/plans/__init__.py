"""Pipelines and query surfaces composed of operators."""
