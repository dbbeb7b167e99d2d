"""Windowed population-genetic analytics as Spark DataFrames."""

from .params import Params

__all__ = ["Params"]
