"""Arrow batches cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text makes a piece of its own.
PIECE_BYTES = 2 << 20


def pieces(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, in record batches with about ``limit`` bytes of ``text_col`` at most."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(text_col)
        text = text if pa.types.is_string(text.type) or pa.types.is_binary(text.type) else pc.cast(text, pa.string())
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, col: str) -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(col).to_pylist()]
