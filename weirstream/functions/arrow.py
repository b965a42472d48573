"""Arrow batches of texts in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute

#: Bytes of text in a piece, unless a single text is longer.
PIECE_BYTES = 1_000_000


def pieces(batch: pa.RecordBatch, text: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts (column number ``text``) hold about ``most`` bytes."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)
