"""Pipelines made of the operators."""
