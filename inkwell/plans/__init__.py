"""Pipelines put together from operators."""
