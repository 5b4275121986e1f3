"""Registered queries over the driver tables, each with its SQL twin."""

from . import q_eval, q_geo, q_heat, q_plume, q_scores, q_sources, q_spectral, q_surface  # noqa: F401
from .registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
