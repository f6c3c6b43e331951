"""Arrays that all tasks of a table make, combined to one of the same shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks that combine what the first tasks have found; the driver gets a row of each.
SUM_TASKS = 16
_KINDS = {"i": np.int64, "f": np.float64}
_SCHEMA = pa.schema([("kind", pa.string()), ("shape", pa.list_(pa.int32())), ("part", pa.binary())])


def _row(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"kind": x.dtype.kind, "shape": list(x.shape), "part": x.astype(_KINDS[x.dtype.kind]).tobytes()}], _SCHEMA)


def _read(r: dict) -> np.ndarray:
    return np.frombuffer(r["part"], _KINDS[r["kind"]]).reshape(r["shape"])


def summed(rows: DataFrame, find: Callable[[Iterator[pa.RecordBatch]], np.ndarray], combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray:
    """The sum over all tasks of the array (of 64-bit integers or doubles, of one shape) that ``find`` makes of a task's batches; or another ``combine`` of them, in any order.

    A task sends one row; ``SUM_TASKS`` tasks combine these, so what the driver gets doesn't grow with the table.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _row(find(batches))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                x = _read(batch.slice(i, 1).to_pylist()[0])
                total = x if total is None else combine(total, x)
        if total is not None:
            yield _row(total)

    described = "kind string, shape array<int>, part binary"
    parts = [_read(r.asDict()) for r in rows.mapInArrow(first, described).repartition(SUM_TASKS).mapInArrow(second, described).collect()]
    if not parts:
        return find(iter(()))
    total = parts[0]
    for x in parts[1:]:
        total = combine(total, x)
    return total
