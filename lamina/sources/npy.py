"""Single arrays in .npy files, as rows of their elements."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ELEMENTS = "path string, dtype string, shape array<bigint>, flat_index bigint, value double"
#: Elements of a batch.
BATCH = 1 << 16


def read_arrays(files: DataFrame) -> DataFrame:
    """Elements of the arrays in files(path, content), as format binaryFile gives them; of complex numbers the real
    parts. Files that hold pickled objects are an error. An empty array has no rows."""

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                flat = (array.real if np.iscomplexobj(array) else array).ravel().astype(np.float64)
                for begin in range(0, len(flat), BATCH):
                    part = flat[begin : begin + BATCH]
                    n = len(part)
                    columns = [pa.array([path] * n), pa.array([array.dtype.str] * n), pa.array([list(array.shape)] * n, pa.list_(pa.int64())), pa.array(np.arange(begin, begin + n)), pa.array(part)]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "dtype", "shape", "flat_index", "value"])

    return files.select("path", "content").mapInArrow(rows, ELEMENTS)
