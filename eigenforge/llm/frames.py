"""Python functions over pandas frames whose whole numbers stay whole, nulls or not."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_WHOLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}


def release_memory() -> None:
    """Gives back what a Python worker freed and still holds: workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As mapInPandas, but a null in a batch does not turn its column's whole numbers into doubles, which hold ids up to
    2^53 only. Columns of whole numbers arrive with pandas' nullable types; empty frames may be yielded."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for frame in run(b.to_pandas(types_mapper=_WHOLE.get) for b in batches):
            yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    return df.mapInArrow(arrow, schema)
