"""Pipelines: thin compositions of the operators."""
