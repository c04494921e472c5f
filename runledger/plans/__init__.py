"""Every query of the engine, by the inventory's identifiers."""

from . import bound, bound_graph, bound_store, bound_streams, bound_texts
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bound", "bound_graph", "bound_store", "bound_streams", "bound_texts"]
