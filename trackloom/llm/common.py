"""Shared pieces of the training-data operators: shared-folder tables, row packing, word hashing.

Everything here is either a DataFrame helper or a small vectorised numpy kernel that runs inside
a task over one slice of one Arrow batch, so memory is bounded by the slice (and by the longest
single text), never by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.sources.tables import discard, discard_made, drop_tables, materialise, recorded, shared_dir  # noqa: F401

#: Bytes of text that one numpy step takes at once (a longer single text is taken whole).
SLICE_BYTES = 1 << 20

#: Column that holds the caller's row while an operator works, so that no name can clash.
ROW = "__row"


# ---------------------------------------------------------------- row packing

def pack(df: DataFrame, **named: Column) -> DataFrame:
    """The caller's row as one struct, beside the operator's own columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[v.alias(k) for k, v in named.items()])


def unpack(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The caller's columns again, then the results; a result replaces an input column of its name.

    Results are computed in a step of their own, where no column of the caller has its name yet.
    """
    done = df.select(ROW, *[v.alias(f"__result{i}") for i, v in enumerate(results.values())])
    kept = [F.col(f"{ROW}.`{c}`").alias(c) for c in columns if c not in results]
    return done.select(*kept, *[F.col(f"__result{i}").alias(k) for i, k in enumerate(results)])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def evenly(text: Column, pieces: int, size: int) -> Column:
    """``text``, or of one longer than ``pieces * size`` characters so many pieces of that size, evenly spaced over the whole."""
    step = F.call_function("div", F.length(text) - size, F.lit(pieces - 1))
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) > pieces * size, F.array_join(cut, "")).otherwise(text)


def text_identity(text: Column) -> list[Column]:
    """Two independent 64-bit lanes that identify a text."""
    return [F.xxhash64(F.lit(0x5BD1E995), text), F.xxhash64(text, F.lit(0x27D4EB2F), F.length(text))]


# ---------------------------------------------------------------- numpy kernels

def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    z = x + _u(0x9E3779B97F4A7C15 * (salt + 1))
    z = (z ^ (z >> np.uint64(30))) * _u(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * _u(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=8)
def _lane(lane: int) -> tuple[int, np.ndarray]:
    rng = np.random.default_rng(9176 + lane)
    base = int(rng.integers(1 << 62, 1 << 63)) * 2 + 1
    return base, rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _u(2) + _u(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i in [0, n)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _u(base)), np.full(size, _u(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def range_hasher(values: np.ndarray, base: int):
    """A function of (start, end) arrays that gives a 64-bit hash of each ``values[start:end]``."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return lambda s, e: (sums[e] - sums[s]) * down[s]


def word_table(kind: str) -> np.ndarray:
    """Which bytes of UTF-8 belong to a word. ``space``: all but ASCII white space; ``alnum``: 0-9, a-z, A-Z, non-ASCII."""
    table = np.ones(256, bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        for first, last in (("0", "9"), ("a", "z"), ("A", "Z")):
            table[ord(first) : ord(last) + 1] = True
    return table


def lower_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the texts in them) for slices of about ``limit`` bytes; null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if not n:
        return
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def find_words(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (one more entry than texts)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < len(raw)]] = False
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; lanes are independent."""
    base, table = _lane(lane)
    return mix(range_hasher(table[raw], base)(starts, ends) + (ends - starts).astype(np.uint64), lane)
