"""Registered queries; importing the modules registers them."""

from . import baseline, events, flows, links, text, upkeep  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
