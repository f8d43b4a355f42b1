"""Documents in chunks of bounded text within a task, and the words of a chunk as hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from quillcast.llm.text_arrays import LOWER, slices, text_buffers, word_bounds, word_hashes

#: Bytes of text and documents of a chunk; a longer document is a chunk of its own.
CHUNK_BYTES, CHUNK_ROWS = 16 << 20, 1 << 17


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(number, batches) of about `most` bytes in column `text` and CHUNK_ROWS rows; numbers differ between tasks."""
    task, k, held, size, rows = TaskContext.get().partitionId() if TaskContext.get() else 0, 0, [], 0, 0
    for batch in batches:
        offs = text_buffers(batch.column(text))[1]
        for lo, hi in slices(offs, most):
            for at in range(lo, hi, CHUNK_ROWS):
                end = min(at + CHUNK_ROWS, hi)
                own = int(offs[end] - offs[at])
                if held and (size + own > most or rows + end - at > CHUNK_ROWS):
                    yield task << 24 | k, held
                    k, held, size, rows = k + 1, [], 0, 0
                held.append(batch.slice(at, end - at))
                size, rows = size + own, rows + end - at
    if held:
        yield task << 24 | k, held


def hashed_words(col: pa.Array, member: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a text column: first row, end row, lower-cased bytes, starts, ends and hashes of all words, and each
    text's number of words. Only A-Z are lower-cased; `member` says which bytes belong to words."""
    data, offs = text_buffers(col)
    for lo, hi in slices(offs):
        part = LOWER[data[offs[lo] : offs[hi]]]
        starts, ends, first = word_bounds(part, offs[lo : hi + 1] - offs[lo], member)
        yield lo, hi, part, starts, ends, word_hashes(part, starts, ends), np.diff(first)
