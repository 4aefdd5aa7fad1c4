"""Delivery-performance analytics for marketplaces, written as Spark DataFrame jobs."""

from parcelwatch.params import Params
from parcelwatch.session import build_session, configure

__all__ = ["Params", "build_session", "configure"]
