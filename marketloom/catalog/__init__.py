"""Queries over the supplied tables, each with the SQL that checks it."""

from marketloom.catalog import views  # noqa: F401
from marketloom.catalog.base import ORACLES, QUERIES
from marketloom.catalog import q_forecast, q_ingest, q_panel, q_policy, q_portfolio, q_streaming  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
