"""Imports every query module so that the registry is complete."""
from .registry import ORACLES, QUERIES  # noqa: F401
from . import q_text, q_pricing, q_linkage, q_review, q_cascade, q_sources, q_stream, q_extract, q_documents  # noqa: F401
