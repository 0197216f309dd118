"""Functions of one row's values as Arrow functions over columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows whose values are Python objects at one time.
SLICE = 64


def by_slices(kind: T.DataType):
    """Make a function of one row's values an Arrow function; a batch of whole texts is never held as Python objects, only SLICE rows of it."""
    arrow = to_arrow_type(kind)

    def made(f: Callable):
        def run(*columns: pa.Array) -> pa.Array:
            out = [
                pa.array([f(*row) for row in zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)], arrow)
                for at in range(0, len(columns[0]), SLICE)
            ]
            return pa.concat_arrays(out) if out else pa.array([], arrow)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return F.arrow_udf(run, kind)

    return made
