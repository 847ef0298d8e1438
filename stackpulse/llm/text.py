"""Words and their hashes over whole Arrow batches of text.

Texts of a batch lie one after another in one UTF-8 buffer. A word is a maximal
run of word bytes inside one text, found for all texts at once. Every word gets
a 64-bit hash from prefix sums of a polynomial over its bytes, so nothing here
loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_powers: dict[str, np.ndarray] = {}

SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False

LETTER_DIGIT = np.zeros(256, bool)
LETTER_DIGIT[0x30:0x3A] = LETTER_DIGIT[0x61:0x7B] = LETTER_DIGIT[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # words of text t are first[t]:first[t + 1]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``limit`` bytes of text (a longer text is a part
    of its own), each with its bytes and the offsets of its texts. Null counts
    as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        width, column = np.int32, column.cast(pa.string())
    _, offset_buffer, data_buffer = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offset_buffer, width)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    at = 0
    while at < n:
        reach = np.cumsum(lengths[at:at + 4096])
        stop = at + max(1, int(np.searchsorted(reach, limit, "right")))
        stop = min(stop, n)
        inner = np.zeros(stop - at + 1, np.int64)
        np.cumsum(lengths[at:stop], out=inner[1:])
        if int(inner[-1]) == int(offsets[stop] - offsets[at]):
            part = data[offsets[at]:offsets[stop]]
        else:
            part = np.concatenate([data[offsets[i]:offsets[i] + lengths[i]] for i in range(at, stop)] or [data[:0]])
        yield batch.slice(at, stop - at), part, inner
        at = stop


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(21, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = np.uint64(pow(int(base), done, 1 << 64))
                out[done:2 * done] = out[:done] * step
                done *= 2
            _powers[name] = out
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n + 1)[0][:n], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``starts`` to ``ends``, wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> Words:
    """Words of already lower-cased texts."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = word_byte[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] = inside[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    sums = prefix_sums(data)
    return Words(starts, ends, span_hashes(sums, starts, ends), np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` words in a row; entry i begins at word i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix(total + hashes[k:k + n] + np.uint64(k + 1))
    return total


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole sequence, apart from those of ``shingles`` by length."""
    total = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            total = mix(np.array([total + h + np.uint64(0x5851F42D4C957F2D)], np.uint64))[0]
    return np.array([total], np.uint64)


def char_positions(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Code-point positions, inside their texts, of byte positions ``at``."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return heads[at] - heads[offsets[text]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_batch(spark, rows: int = 2048) -> None:
    """Bound the batches that carry texts to Python, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
