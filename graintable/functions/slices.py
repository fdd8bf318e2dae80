"""Row functions over text columns that hold the Python objects of few rows at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 128  # rows whose Python objects are alive at once; a batch of Arrow has thousands

KINDS = {"string": (T.StringType(), pa.string()), "array<string>": (T.ArrayType(T.StringType()), pa.list_(pa.string()))}


def sliced(f: Callable, kind: str, together: bool = False) -> Callable[[Column], Column]:
    """A column function that gives f of each value (null: None), as ``kind``; with ``together``, f takes and gives the values of a slice in a list. Results go to Arrow slice by slice, so a worker's memory is that of its batch, not of its batch's objects."""

    returned, held = KINDS[kind]
    each = f if together else lambda values: map(f, values)

    @F.arrow_udf(returned)
    def run(values: pa.Array) -> pa.Array:
        parts = [pa.array(each(values.slice(at, SLICE).to_pylist()), held) for at in range(0, len(values), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], held)

    return run
