"""Query plans; importing it registers every query."""

from . import catalogue, mapping_queries, package_queries, series_queries  # noqa: F401
