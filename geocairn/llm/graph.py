"""Connected components: those of a graph by joins, and those of one unit of work as a matrix."""

from __future__ import annotations

from ..operators.graph import components

__all__ = ["components", "local_roots"]


def local_roots(links) -> "list":
    """For a boolean matrix of links, rows against columns: the component of each row and column, as numbers that the two share."""
    import numpy as np

    n, m = links.shape
    rows = np.arange(n)
    while True:
        columns = np.where(links, rows[:, None], n + m).min(axis=0, initial=n + m)
        columns = np.where(columns == n + m, n + np.arange(m), columns)
        new = np.minimum(rows, np.where(links, columns[None, :], n + m).min(axis=1, initial=n + m))
        if (new == rows).all():
            return rows, columns
        rows = new
