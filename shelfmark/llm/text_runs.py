"""Texts of Arrow batches as bytes, some megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

_RUN = 4 << 20


def runs(batches: Iterator[pa.RecordBatch], size: int = _RUN) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches whose texts hold about `size` bytes, and the texts; null texts are empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        first, held, texts = 0, 0, []
        for k in range(len(column)):
            value = column[k]
            text = value.as_buffer().to_pybytes() if value.is_valid else b""
            texts.append(text)
            held += len(text)
            if held >= size:
                yield batch.slice(first, k + 1 - first), texts
                first, held, texts = k + 1, 0, []
        if texts:
            yield batch.slice(first), texts
