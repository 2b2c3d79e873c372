"""Arrow columns a slice at a time, so that Python holds the values of a few rows, however many a batch has."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa


def by_slices(f: Callable[..., pa.Array], kind: pa.DataType, rows: int, *columns: pa.Array) -> pa.Array:
    """``f`` of each ``rows`` rows of the columns, put together; of none it is an empty column of ``kind``."""
    parts = [f(*[c.slice(at, rows) for c in columns]) for at in range(0, len(columns[0]), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
