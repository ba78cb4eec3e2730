"""Arrow plumbing shared by the Python-side operators: bounded slices of text columns, as byte buffers or strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; temporaries are a small multiple of it.
SLICE_BYTES = 2 << 20


@dataclass
class TextBlock:
    """A few consecutive rows: `data[offsets[i]:offsets[i + 1]]` are the UTF-8 bytes of row i."""

    rows: pa.RecordBatch
    column: pa.Array
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def texts(self) -> list[str]:
        return self.column.to_pylist()

    def raw(self) -> list[bytes]:
        whole, o = self.data.tobytes(), self.offsets.tolist()
        return [whole[a:b] for a, b in zip(o, o[1:], strict=False)]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[TextBlock]:
    """Cuts batches into blocks of about `limit` bytes of text (one row at least); null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
        _, offsets = _buffers(column)
        start = 0
        while start < len(column):
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), len(column))
            part = column.slice(start, stop - start)
            data, o = _buffers(part)
            yield TextBlock(batch.slice(start, stop - start), part, data, o)
            start = stop


def map_blocks(
    df: DataFrame,
    key: str | None,
    text: str,
    schema: str,
    work: Callable[[Iterator[TextBlock]], Iterator[dict]],
    arrow: pa.Schema,
) -> DataFrame:
    """Runs `work` over blocks with columns `key` and `text`; what it yields (column name to array) become rows.

    Only these two columns travel to Python, so further columns of any name do no harm.
    """
    picked = [F.col(f"`{text}`").cast("string").alias("text")] + ([F.col(f"`{key}`").cast("long").alias("key")] if key else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(blocks(batches)):
            yield pa.RecordBatch.from_arrays([a if isinstance(a := out[f.name], pa.Array) else pa.array(a, f.type) for f in arrow], schema=arrow)

    return df.select(*picked).mapInArrow(run, schema)
