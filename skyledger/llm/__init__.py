"""Operators for preparing text corpora. Nothing else in the library imports this subpackage.

The queries are loaded on first use: a Python worker that needs one operator does not load the others.
"""

__all__ = ["QUERIES", "TWINS"]


def __getattr__(name: str):
    if name in __all__:
        from . import queries

        return getattr(queries, name)
    raise AttributeError(name)
