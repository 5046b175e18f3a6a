"""Vectorised hashing of the words of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x2545F4914F6CDD1D & (2**64 - 1))) * M1
        x ^= x >> np.uint64(29)
        x *= M2
        return x ^ (x >> np.uint64(32))


def hashes(values: list[str]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(v) for v in values), np.uint64, len(values))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words by text); null texts have none. ``lower`` folds A-Z."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, lengths = split.flatten(), np.diff(split.offsets.to_numpy())
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64)
    coded = pc.dictionary_encode(flat)
    h = hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)[full]
    return h[full], np.bincount(owner, minlength=len(lengths)).astype(np.int64)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``size`` bytes of text in ``column``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(lengths.tolist()):
        held += n
        if held >= size:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Gives freed memory back to the system: workers live on between stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` that ends by releasing memory, also every few batches."""

    def run(batches: Iterator) -> Iterator:
        for k, out in enumerate(work(batches), 1):
            yield out
            if k % 16 == 0:
                release()
        gc.collect()
        release()

    return run
