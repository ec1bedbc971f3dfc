"""Requests and the plans that answer them."""

from quarryweb.plans.extract import extract
from quarryweb.plans.request import Request

__all__ = ["Request", "extract"]
