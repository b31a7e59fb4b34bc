"""Arrow batches of texts in Python workers, a bounded part at a time."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker holds as Python objects at once, unless one text is longer.
PART_BYTES = 1 << 21


def parts(batch: pa.RecordBatch, column: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut, without a copy, into parts of at most ``most`` bytes of text, of one row at least."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held + n > most and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(batch):
        yield batch.slice(start)


def by_parts(column: str) -> Callable:
    """Makes a function of one part, which yields batches, into one for mapInArrow. A worker gives its
    freed memory back to the system when a task ends."""

    def wrap(run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
        @functools.wraps(run)
        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                for batch in batches:
                    for part in parts(batch, column):
                        yield from run(part)
            finally:
                pa.default_memory_pool().release_unused()
                with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                    ctypes.CDLL(None).malloc_trim(0)

        return every

    return wrap
