"""Pipelines made of several operators, and the registry of queries."""
