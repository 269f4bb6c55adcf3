"""Vectorised word scanning over the concatenated UTF-8 bytes of many texts.

An Arrow string column already is one byte buffer with offsets; the functions here read that
buffer with NumPy, so that no Python string is made for a word.  A block of texts is turned into
``Words``: every word's bytes, lower-cased in A-Z only, each followed by one space, texts in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text scanned at once; bounds the memory of a task whatever the texts' lengths add to.
BLOCK_BYTES = 2 << 20


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


LOWER = _lower_table()


def class_table(separators: bytes) -> np.ndarray:
    """True for each byte value that belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: Words are runs of anything but white space.
NOT_SPACE = class_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters, digits and all bytes above 0x7F.
ALNUM = class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: The same for text that isn't lower-cased yet.
ALNUM_RAW = class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@dataclass
class Words:
    """norm: word bytes, a space after each; start, end: of each word in norm; text: the text that
    each word is in; first: the index of each text's first word, and the number of words last."""

    norm: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``size`` bytes; a longer text is a range by itself."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def scan_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of the texts raw[offsets[i]:offsets[i+1]]; ``table`` holds for bytes after lower-casing."""
    n = len(offsets) - 1
    base = offsets[0]
    raw, offsets = raw[base : offsets[-1]], offsets - base
    low = LOWER[raw]
    inside = table[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    at, last = np.flatnonzero(begins), np.flatnonzero(ends)
    lengths = last - at + 1
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    norm = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
    if len(end):
        keep = np.ones(len(norm), dtype=bool)
        keep[end] = False
        norm[keep] = low[inside]
    first = np.searchsorted(at, offsets)
    return Words(norm, start, end, np.repeat(np.arange(n), np.diff(first)), first)
