"""Queries over the given tables, one per operator."""

from . import cards, cells, marks, predictions, rasters, sheets, vectors
from .registry import BUILDS, ORACLES

__all__ = ["BUILDS", "ORACLES", "cards", "cells", "marks", "predictions", "rasters", "sheets", "vectors"]
