"""Importing this module registers every query."""

from . import catalogue_queries, change_queries, geometry_queries, pixel_queries, review_queries, search_queries  # noqa: F401
