"""Array code over Arrow text columns that the Python-side operators share.

Everything works on the UTF-8 bytes of many texts at once; no step loops over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from partweave.session import give_back

#: Bytes of text that one step works on; temporaries take about 40 bytes for each. A longer text is a step of its own.
STEP_BYTES = 512 << 10

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A fixed random value for each byte, equal for A-Z and a-z.
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            out = np.full(n, b, U)
            out[0] = U(1)
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (uint64), a function of its contents alone."""
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * _BASE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than rows); null is empty."""
    column = column.fill_null("").cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What operators keep in a worker between tasks, by operator: compiled models and remembered words.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """The operator's own store in this worker; the stores of others are emptied, since workers serve many operators."""
    for name in [n for n in _kept if n != owner]:
        del _kept[name]
    return _kept.setdefault(owner, {})


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES, owner: str = "") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text each, with bytes and offsets."""
    kept(owner)
    for batch in batches:
        at = batch.schema.get_field_index(text)
        data, offsets = text_bytes(batch.column(at))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            begin = end
        del batch, data, offsets
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of words before each text (one more than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with A-Z read as a-z."""
    return span_hashes(_VALUE[data], starts, ends)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text the distinct hashes of its ``size``-word shingles, sorted; fewer words make one shingle."""
    starts, ends, first = words(data, offsets)
    w = word_hashes(data, starts, ends)
    n = len(w) - size + 1
    if n > 0:
        rolled = w[:n].copy()
        for k in range(1, size):
            rolled *= _BASE
            rolled += w[k : k + n]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = w[a : a + 1].copy()
            for k in range(a + 1, b):
                short = short * _BASE + w[k]
            out.append(mix(short + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
