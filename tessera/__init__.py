"""tessera: distributed sparse linear algebra on Spark DataFrames.

A matrix is a DataFrame of non-zero entries ``(i, j, v)`` with a declared
shape (:class:`Mat`); a vector is ``(i, v)`` with a declared size
(:class:`Vec`).  Operators are joins, unions, windows and aggregates planned
by Catalyst and adaptive execution.
"""

from tessera.core import ENTRY_SCHEMA, VECTOR_SCHEMA, Mat, Vec, cut_lineage

__all__ = ["ENTRY_SCHEMA", "VECTOR_SCHEMA", "Mat", "Vec", "cut_lineage"]
