"""Registered queries: importing this package registers them all."""

from . import lattice_queries, queries, request_queries  # noqa: F401
