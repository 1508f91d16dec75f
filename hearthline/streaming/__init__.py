"""Loads and transforms of files as they arrive."""

from .arrivals import arrival_output, load_arrivals, transform_arrivals

__all__ = ["arrival_output", "load_arrivals", "transform_arrivals"]
