"""Removal of long repeated passages by recompression in Spark rounds.

A window is ``window`` consecutive words of one text; a word goes if a window over it occurs elsewhere.

Setting aside. One pass over all texts parses each by itself and emits an anchor for about 12 words: the
smallest-named symbol inside a window, with some words around it, which equal windows have in common. Windows
whose anchors occur in one place only can't repeat; only the stretches of text under the others go on. Names are hashes here,
so a collision keeps too much and never loses a repeat.

Rounds. The words of the stretches are named by a global dictionary, a Spark table with one row for each
different word. Then each round takes the texts as sequences of symbols and names (i) every maximal run
of one symbol and (ii) every pair of a left element and a right one after it, by another such dictionary
with one row for each different run or pair: whether a symbol is left or right is a bit of its name, so
equal passages are parsed equally but at their edges. Names are numbers given by the dictionary, not
hashes of the content: by induction two symbols have the same name if and only if they stand for the
same words. After ``ROUNDS`` rounds symbols cover several words each.

Finding. Of the symbols that lie inside a window whatever its context (those not cut by its borders, nor
next to a symbol that is), the longest one of the second round is its anchor, or of a lower one if there is none; equal
windows have equal anchors at equal offsets. Windows next to each other with one anchor form a stretch.
A stretch is spelled in the fewest symbols that don't depend on its context; equal spellings are equal
words, so grouping by anchor and spelling verifies repeats without looking at a word again. If all
stretches of an anchor repeat, so do all their windows. For the other anchors, at the edges of repeats,
the windows of each different stretch are compared by anchor, offset and a 64-bit hash of word names.

Stretches are dealt out in chunks of about ``CHUNK_WORDS``, and a chunk emits each of its symbols' parts once.
Exact copies are told by two 64-bit hashes of the text and count as one place. Every join has a summed
side with one row for a name or text and AQE splits the other, so frequent passages and groups of
copies meet in no single task. Tables of a finished step are deleted when the next one is written.

Defined results: null text has no words; texts below ``window`` words keep all; repeated rows are
copies of each other; kept words are joined by one blank; a text of any length is one row of a task;
result columns replace input columns of their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import (
    ROW,
    discard,
    find_words,
    materialise,
    mix,
    pack,
    range_hasher,
    text_identity,
    text_or_empty,
    text_slices,
    unpack,
    word_hashes,
    word_table,
)

WINDOW = 35
ROUNDS = 3
#: The highest level of symbols that windows are known by; those of higher ones reach too far into a window's borders.
ANCHOR_LEVEL = 2
#: The level of windows that are one word over and over.
RUN = -1
#: Words of a chunk, about.
CHUNK_WORDS = 1 << 17
#: Rounds of the parse that sets text aside, and the words on each side that decide a boundary after them.
LOCAL_ROUNDS, MARGIN = 2, 2
#: Words on each side that an anchor is known by besides: the more, the fewer windows go on that only have a few words in common.
AROUND = 6
_LOW = np.uint64(0xFFFFFFFF)
_SPACE = word_table("space")
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``first[i]``, ``first[i] + 1``, ... of which there are ``n[i]``, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _range_best(score: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest score in each [lo, hi)."""
    best, table = np.zeros(len(lo), np.uint64), score
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        best[at] = np.maximum(table[lo[at]], table[hi[at] - 2**k])
        table = np.maximum(table[: -(2**k)], table[2**k :]) if len(table) > 2**k else table[:0]
    return best


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of some pieces begins that stand one after the other."""
    return np.cumsum(sizes, dtype=np.int64) - sizes


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


# ---------------------------------------------------------------- setting aside

def local_parse(names: np.ndarray, heads: np.ndarray, rounds: int = LOCAL_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after some rounds over one slice; ``heads`` marks the first word of each text."""
    starts, head = np.arange(len(names)), heads
    for k in range(rounds):
        left = (mix(names, 11 + k) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(names), bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~head[1:]
        first = np.ones(len(names), bool)
        first[1:] = ~pair[:-1]
        second = np.roll(names, -1)
        named = np.where(pair, mix(names * np.uint64(0xA0761D6478BD642F) + mix(second, 23 + k), 29 + k), names)
        names, starts, head = named[first], starts[first], head[first]
    return names, starts


class Anchors:
    """The anchors of the texts of one slice: ``keys``, their text, place, and first and last window."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, window: int):
        self.starts, self.ends, self.firsts = find_words(raw, off, _SPACE)
        n, sizes = len(self.starts), np.diff(self.firsts)
        count = np.maximum(sizes - window + 1, 0)
        text = np.repeat(np.arange(len(sizes)), count)
        s = _ragged(self.firsts[:-1], count)
        if not len(s):
            self.text = self.low = self.high = self.q = np.zeros(0, np.int64)
            self.keys = np.zeros(0, np.uint64)
            return
        names, heads = word_hashes(raw, self.starts, self.ends), np.zeros(n + 1, bool)
        heads[self.firsts[:-1]] = True
        symbols, q = local_parse(names, heads[:n])
        p = np.append(q[1:], n)
        is_start = np.zeros(n + 1, np.int64)
        is_start[q] = 1
        before = np.concatenate([[0], np.cumsum(is_start)])  # symbols that start before word i
        around = max(MARGIN, min(AROUND, (window - 7) // 2))  # leaves room for any symbol
        lo, hi = before[s + around], before[s + window - around + 1] - 1
        hi = np.where(s + window - around == n, len(q), hi)
        # Symbols [lo, hi) lie wholly in the window's interior; smallest name, then leftmost.
        score = (mix(symbols, 41) & ~_LOW) | (_LOW - np.arange(len(symbols), dtype=np.uint64))
        chosen = (_LOW - (_range_best(score, lo, hi) & _LOW)).astype(np.int64)
        edge = _changes(chosen)
        self.low, self.high = s[edge], s[np.r_[edge[1:], len(s)] - 1]
        self.text, self.q = text[edge], q[chosen[edge]]
        self.keys = mix(range_hasher(names, _BASES[0])(self.q - around, p[chosen[edge]] + around), 43)


def _emit_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1 = batch["r1"].to_numpy().view(np.uint64)
            for lo, hi, raw, off in text_slices(batch["text"]):
                a = Anchors(raw, off, window)
                place = mix(mix(r1[lo:hi][a.text], 47) + (a.q - a.firsts[a.text]).astype(np.uint64), 53)
                yield pa.RecordBatch.from_arrays([_signed(a.keys), _signed(place), _signed(r1[lo:hi][a.text])], ["key", "place", "r1"])

    return run


_STRETCHES = "array<struct<r1:bigint,r2:bigint,start:bigint,n:int>>"
_STRETCH = pa.struct([("r1", pa.int64()), ("r2", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _chunk(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row: the stretches, the code of each of their words, and the words that the codes stand for."""
    r1, r2, start, n, name = (np.concatenate([p[c] for p in parts]) for c in range(5))
    spelled = [w for p in parts for w in p[5]]
    _, one, code = np.unique(name, return_index=True, return_inverse=True)
    stretches = pa.StructArray.from_arrays([pa.array(r1), pa.array(r2), pa.array(start), pa.array(n.astype(np.int32))], fields=list(_STRETCH))
    return pa.RecordBatch.from_arrays([_one_list(stretches), _one_list(pa.array(code.astype(np.int32))), _one_list(pa.array([spelled[x] for x in one.tolist()], pa.binary()))], ["stretches", "codes", "words"])


def _set_aside(window: int):
    """Chunks of the stretches of words under shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, size = None, [], 0
        for batch in batches:
            r1, r2 = (batch[c].to_numpy() for c in ("r1", "r2"))
            for lo, hi, raw, off in text_slices(batch["text"]):
                a = Anchors(raw, off, window)
                listed = batch["keys"].slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), np.asarray(listed.value_lengths()))
                wanted = np.sort(mix(listed.flatten().to_numpy().view(np.uint64) + mix(owner.astype(np.uint64), 59), 61))
                mine = mix(a.keys + mix(a.text.astype(np.uint64), 59), 61)
                at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                shared = wanted[at] == mine if len(wanted) else np.zeros(len(mine), bool)
                # Copies of a text come one after the other, as rows are joined in order of their identity.
                new = np.ones(hi - lo, bool)
                new[1:] = (r1[lo + 1 : hi] != r1[lo : hi - 1]) | (r2[lo + 1 : hi] != r2[lo : hi - 1])
                new[0] = (r1[lo], r2[lo]) != seen
                seen = (r1[hi - 1], r2[hi - 1])
                shared = np.flatnonzero(shared & new[a.text])
                if not len(shared):
                    continue
                low, end, text = a.low[shared], a.high[shared] + window, a.text[shared]
                first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (low[1:] > end[:-1])])
                low, end, text = low[first], np.maximum.reduceat(end, first), text[first]
                words = _ragged(low, end - low)
                w0, w1 = a.starts[words], a.ends[words]
                data = raw.tobytes()
                parts.append((r1[lo:hi][text], r2[lo:hi][text], low - a.firsts[text], end - low, word_hashes(raw, w0, w1) ^ mix(word_hashes(raw, w0, w1, 1), 3), [data[x:y] for x, y in zip(w0.tolist(), w1.tolist(), strict=True)]))
                size += len(words)
                if size >= CHUNK_WORDS:
                    yield _chunk(parts)
                    parts, size = [], 0
        if parts:
            yield _chunk(parts)

    return run


# ---------------------------------------------------------------- rounds

ROUND = "chunk long, n array<int>, names array<bigint>, sizes array<int>, next array<bigint>, next_sizes array<int>, codes array<int>, a array<bigint>, b array<bigint>, times array<bigint>"


def elements(names: np.ndarray, starts: np.ndarray, heads: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs and pairs of a round: (first symbol of each, a, n, b, m), ``n`` times ``a`` and then ``m`` times ``b``, or none.

    ``heads``: the words at which stretches begin, which no run or pair goes across.
    """
    head = np.zeros(len(names) + 1, bool)
    head[np.searchsorted(starts, heads)] = True
    first = np.ones(len(names), bool)
    first[1:] = (names[1:] != names[:-1]) | head[1 : len(names)]
    run = np.flatnonzero(first)
    a, n = names[run], np.diff(np.r_[run, len(names)])
    left = (mix(a.view(np.uint64), 11 + k) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(run), bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~head[run[1:]]
    kept = np.ones(len(run), bool)
    kept[1:] = ~pair[:-1]
    b, m = np.where(pair, np.roll(a, -1), 0), np.where(pair, np.roll(n, -1), 0)
    return run[kept], a[kept], n[kept], b[kept], m[kept]


def _distinct_parts(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each different (a, b, times), and the number of each row's."""
    order = np.lexsort((times, b, a))
    new = _changes(a[order], b[order], times[order]) if len(a) else order
    code = np.empty(len(a), np.int64)
    code[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(a)]))
    return order[new], code


def _round(k: int):
    """The symbols of round ``k`` with their names filled in, and the runs and pairs that the next round has to name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                n, codes, names, sizes = (row[c].flatten().to_numpy() for c in ("n", "codes", "names", "sizes"))
                given = row["given"].flatten()
                name = np.zeros(len(given) + 1, np.int64)
                name[given.field("pos").to_numpy()] = given.field("name").to_numpy()
                names = name[codes] if k == 0 else np.where(codes >= 0, name[codes], names)
                sizes = np.ones(len(codes), np.int32) if k == 0 else sizes
                following, next_sizes, code, a, b, times = (np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64, np.int64, np.int64))
                if k < ROUNDS:
                    first, following, c, second, m = elements(names, _starts(sizes), np.cumsum(n, dtype=np.int64) - n, k)
                    next_sizes = np.add.reduceat(sizes, first, dtype=np.int32) if len(first) else next_sizes
                    new = np.flatnonzero((c > 1) | (m > 0))
                    one, number = _distinct_parts(following[new], second[new], (c[new] << 32) + m[new])
                    code = np.full(len(first), -1, np.int32)
                    code[new] = number
                    new = new[one]
                    a, b, times = following[new], second[new], (c[new] << 32) + m[new]
                yield pa.RecordBatch.from_arrays(
                    [row["chunk"], *(_one_list(pa.array(x)) for x in (n, names, sizes, following, next_sizes, code, a, b, times))], ["chunk", "n", "names", "sizes", "next", "next_sizes", "codes", "a", "b", "times"]
                )

    return run


def _named(listed: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(chunk, given): the names of the ``keys`` at each place of each chunk (chunk, pos, keys), by a global dictionary of one row for each different key.

    The number of a name ends in its round, so names of different rounds differ.
    """
    dictionary = listed.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks")).select(*keys, (F.monotonically_increasing_id() * (ROUNDS + 1) + k).alias("name"))
    dictionary = materialise(dictionary, f"names-{k}")
    given = listed.join(dictionary, keys).groupBy("chunk").agg(F.collect_list(F.struct("pos", "name")).alias("given"))
    given = materialise(given, f"given-{k}")
    discard(dictionary)
    return given


def rounds(chunks: DataFrame) -> list[DataFrame]:
    """For each round (chunk, names, sizes): the names and numbers of words of all symbols of ``chunks`` (chunk, stretches, codes, words) after it."""
    none, levels, last = F.array().cast("array<struct<pos:int,name:bigint>>"), [], None
    for k in range(ROUNDS + 1):
        if last is None:
            listed, keys = chunks.select("chunk", F.posexplode("words").alias("pos", "word")), ["word"]
            rows = chunks.select("chunk", F.col("stretches.n").alias("n"), "codes", F.array().cast("array<bigint>").alias("names"), F.array().cast("array<int>").alias("sizes"))
        else:
            keys = ["a", "b", "times"]
            listed = last.select("chunk", F.posexplode(F.arrays_zip(*keys)).alias("pos", "p")).select("chunk", "pos", *[F.col(f"p.{c}").alias(c) for c in keys])
            rows = last.select("chunk", "n", "codes", F.col("next").alias("names"), F.col("next_sizes").alias("sizes"))
        given = _named(listed, keys, k)
        rows = rows.join(given, "chunk", "left").withColumn("given", F.coalesce("given", none))
        done = materialise(rows.mapInArrow(_round(k), ROUND), f"round-{k}")
        discard(given)
        if last is not None:  # what the next round was made of isn't needed any more
            levels.append(materialise(last.select("chunk", "names", "sizes"), f"level-{k - 1}"))
            discard(last)
        last = done
    return [*levels, last]


# ---------------------------------------------------------------- finding

class Levels:
    """The symbols of a chunk after each round, and which of them don't depend on what is around a range of words."""

    def __init__(self, names: list[np.ndarray], starts: list[np.ndarray]):
        self.names, self.starts = names, starts
        self.size = len(names[0])
        self.ends = [np.append(s[1:], self.size) for s in starts]
        #: For each symbol of the level below, the symbol that holds it.
        self.above = [np.searchsorted(up, below, side="right") - 1 for below, up in zip(starts, starts[1:], strict=False)]

    def inside(self, low: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the symbols [l, r) within the words [low, end) that any other text around them would leave as they are.

        Whatever the symbols at the borders of a level are joined with, it happens in the symbols of the next
        level that hold them; all between is decided inside.
        """
        found = [(low, end)]
        for above in self.above:
            l, r = found[-1]
            some = r > l
            l, r = np.where(some, above[np.minimum(l, len(above) - 1)] + 1, 0), np.where(some, above[np.maximum(r - 1, 0)], 0)
            found.append((l, np.maximum(l, r)))
        return found

    def anchors(self, low: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(level, symbol): the longest symbol of the highest level, up to ``ANCHOR_LEVEL``, that has any inside; of equal length by a hash of the name, then the first.

        Long runs may leave only single words inside: then it is a word that differs from the one before it. In a
        window of one word over and over there is none: the level is ``RUN`` and the symbol the run's first word.
        """
        level, symbol = np.full(len(low), RUN), np.zeros(len(low), np.int64)

        def choose(k: int, at: np.ndarray, length: np.ndarray, name: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
            index = np.arange(len(name), dtype=np.uint64)
            score = (np.minimum(length, 1023).astype(np.uint64) << np.uint64(54)) | ((mix(name.view(np.uint64), 41) >> np.uint64(42)) << np.uint64(32)) | (_LOW - index)
            level[at] = k
            return (_LOW - (_range_best(score, l[at], r[at]) & _LOW)).astype(np.int64)

        for k, (l, r) in reversed(list(enumerate(self.inside(low, end)[1 : ANCHOR_LEVEL + 1], 1))):
            at = np.flatnonzero((r > l) & (level == RUN))
            if len(at):
                symbol[at] = choose(k, at, self.ends[k] - self.starts[k], self.names[k], l, r)
        words = self.names[0]
        turns = _changes(words)
        l, r = np.searchsorted(turns, low + 1), np.searchsorted(turns, end)
        at = np.flatnonzero((r > l) & (level == RUN))
        if len(at):
            symbol[at] = turns[choose(0, at, np.ones(len(turns), np.int64), words[turns], l, r)]
        at = np.flatnonzero(level == RUN)
        symbol[at] = turns[np.searchsorted(turns, low[at], side="right") - 1]
        return level, symbol

    def spelled(self, low: np.ndarray, end: np.ndarray, head: np.ndarray) -> pa.Array:
        """``head`` and the names that spell the words [low, end): symbols of the highest level inside, and of lower ones at the borders."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (range, order, name)
        ids = np.arange(len(low))
        parts.append((ids, np.full(len(low), -1.0), head))
        found = self.inside(low, end)

        def put(k: int, l: np.ndarray, r: np.ndarray) -> None:
            n = np.maximum(r - l, 0)
            at = _ragged(l, n)
            parts.append((np.repeat(ids, n), self.starts[k][at].astype(np.float64), self.names[k][at]))

        for k, (l, r) in enumerate(found):
            if k + 1 < len(found):
                up_l, up_r = found[k + 1]
                more = up_r > up_l
                first = np.where(more, np.searchsorted(self.starts[k], self.starts[k + 1][np.minimum(up_l, len(self.starts[k + 1]) - 1)]), r)
                last = np.where(more, np.searchsorted(self.starts[k], self.ends[k + 1][np.maximum(up_r - 1, 0)]), r)
                put(k, l, first)
                put(k, last, r)
            else:
                put(k, l, r)
        owner, place, name = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, owner))
        offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(low)))] * 8
        return pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(name[order].astype(np.int64).tobytes())])


def _stretches(window: int):
    """For each anchor of a chunk: its name, its place, how its windows together are spelled, and the hash of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                names, sizes = ([row[f"{c}{k}"].flatten().to_numpy().astype(np.int64) for k in range(ROUNDS + 1)] for c in ("names", "sizes"))
                levels = Levels(names, [_starts(x) for x in sizes])
                of = row["stretches"].flatten()
                r1, r2, start, n = (of.field(c).to_numpy() for c in ("r1", "r2", "start", "n"))
                begin = np.cumsum(n, dtype=np.int64) - n
                count = np.maximum(n - window + 1, 0)
                text, s = np.repeat(np.arange(len(n)), count), _ragged(begin, count)
                level, symbol = levels.anchors(s, s + window)
                edge = _changes(text, level, symbol)
                low, high, text = s[edge], s[np.r_[edge[1:], len(s)] - 1], text[edge]
                level, symbol = level[edge], symbol[edge]
                # Windows of one word over and over are equal: one row stands for all of a run, another for the last of several.
                run = np.flatnonzero((level == RUN) & (high > low))
                low, high, text, level, symbol = (np.r_[x, x[run]] for x in (low, high, text, level, symbol))
                low[len(edge) :] = high[len(edge) :]
                key, q = -levels.names[0][low] - 1, low.copy()
                for k in range(len(levels.names)):
                    m = level == k
                    key[m], q[m] = levels.names[k][symbol[m]], levels.starts[k][symbol[m]]
                windows = np.where(level == RUN, 1, high - low + 1)
                whole = levels.spelled(low, low + windows - 1 + window, (q - low) * 4096 + windows)
                k = high - low + 1
                each = _ragged(low, windows)
                hashed = range_hasher(mix(levels.names[0].view(np.uint64), 17), _BASES[1])
                hashes = mix(hashed(each, each + window) + mix((np.repeat(q, windows) - each).astype(np.uint64), 73), 79)
                place = mix(mix(r1[text].view(np.uint64), 47) + (q - begin[text] + start[text]).astype(np.uint64), 53)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        _signed(place),
                        pa.array(r1[text]),
                        pa.array(r2[text]),
                        whole,
                        pa.array(low - begin[text] + start[text]),
                        pa.array(k),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(windows)].astype(np.int32)), _signed(hashes)),
                    ],
                    ["key", "place", "r1", "r2", "whole", "low", "n", "windows"],
                )

    return run


def _cut(window: int):
    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def cut(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, twin, ranges in texts:
            words_n, removed_n, kept = [], [], []
            for t, copied, cuts in zip(text.to_pylist(), twin.to_pylist(), ranges.to_pylist(), strict=True):
                words = t.encode().split()
                n = len(words)
                if copied and n >= window:
                    words = []
                elif cuts:
                    change = np.zeros(n + 1, np.int64)
                    for c in cuts:
                        for a, b in [(c["a"], c["b"])] if c["ks"] is None else [(c["a"] + k, c["a"] + k + window) for k in c["ks"]]:
                            change[a] += 1
                            change[b] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
                words_n.append(n)
                removed_n.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.StructArray.from_arrays([pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])

    return cut


def _several(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur in more than one place."""
    return df.groupBy(*keys).agg(F.min("place").alias("p"), F.max("place").alias("q")).where("p <> q").select(*keys)


def repeated(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(r1, r2, ranges): for each different text with repeats, what repeated windows cover.

    A range is the words [a, b), or, where ``ks`` lists numbers, the windows that begin at a + k.
    """
    r1, r2 = text_identity(text_or_empty(text))
    texts = df.select(r1.alias("r1"), r2.alias("r2"), text_or_empty(text).alias("text"))
    anchors = materialise(texts.select("r1", "text").mapInArrow(_emit_anchors(window), "key long, place long, r1 long"), "anchors")
    shared = materialise(_several(anchors, "key"), "shared")
    # Half the identity is enough here: a text that gets another's keys too has no such anchors.
    keys = materialise(anchors.join(shared, "key", "left_semi").groupBy("r1").agg(F.collect_set("key").alias("keys")), "keys")
    discard(anchors, shared)
    held = texts.join(keys, "r1").select("r1", "r2", "text", "keys")
    chunks = held.mapInArrow(_set_aside(window), f"stretches {_STRETCHES}, codes array<int>, words array<binary>")
    chunks = materialise(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    discard(keys)
    parsed = rounds(chunks)
    whole = chunks.select("chunk", "stretches")
    for k, level in enumerate(parsed):
        whole = whole.join(level.select("chunk", F.col("names").alias(f"names{k}"), F.col("sizes").alias(f"sizes{k}")), "chunk")
    found = whole.drop("chunk").mapInArrow(_stretches(window), "key long, place long, r1 long, r2 long, whole binary, low long, n long, windows array<long>")
    found = materialise(found, "stretches")
    discard(chunks, *parsed)

    spellings = found.groupBy("key", "whole").agg((F.min("place") != F.max("place")).alias("many"), F.first("windows").alias("windows"))
    spellings = materialise(spellings.withColumn("id", F.monotonically_increasing_id()), "spellings")
    lone = materialise(spellings.where("not many").select("key").distinct(), "lone")
    slim = found.select("key", "r1", "r2", "low", "n")
    none = F.lit(None).cast("array<int>")
    whole = slim.join(lone, "key", "left_anti").select("r1", "r2", F.col("low").alias("a"), (F.col("low") + F.col("n") - 1 + window).alias("b"), none.alias("ks"))
    whole = materialise(whole, "whole")

    # Equal stretches are compared once: a window repeats if its stretch does, or if another stretch has it too. A window's row has
    # its stretch's number instead of the spelling, and as the table isn't dealt out by key, an anchor's windows meet in many tasks.
    edges = materialise(spellings.join(lone, "key", "left_semi").select("id", "key", "many", "windows"), "edges")
    each = edges.select("id", "key", "many", F.posexplode("windows").alias("k", "window"))
    twice = each.groupBy("key", "window").agg(F.max("many").alias("many"), F.min("id").alias("p"), F.max("id").alias("q")).where("many or p <> q").select("key", "window")
    twice = materialise(twice, "windows")
    partly = each.where("not many").join(twice, ["key", "window"], "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    made = materialise(partly.unionByName(edges.where("many").select("id", none.alias("ks"))), "good")
    discard(edges, twice)
    good = spellings.select("id", "key", "whole").join(made, "id").drop("id")
    single = found.select("key", "whole", "r1", "r2", "low", "n").join(good, ["key", "whole"])
    single = single.select("r1", "r2", F.col("low").alias("a"), F.when(F.col("ks").isNull(), F.col("low") + F.col("n") - 1 + window).alias("b"), "ks")
    ranges = whole.unionByName(single).groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b", "ks")).alias("ranges"))
    ranges = materialise(ranges, "ranges")
    discard(found, spellings, lone, whole, made)
    return ranges


def remove(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` and ``kept_text`` (its words that no repeated window covers)."""
    r1, r2 = text_identity(text_or_empty(text))
    keyed = pack(df, r1=r1, r2=r2)
    twins = keyed.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r1", "r2", F.lit(True).alias("twin"))
    joined = keyed.join(repeated(df, text, window).join(twins, ["r1", "r2"], "full"), ["r1", "r2"], "left")
    body = F.coalesce(F.col(f"{ROW}.`{text}`").cast("string"), F.lit(""))
    cut = _cut(window)(body, F.coalesce("twin", F.lit(False)), F.coalesce("ranges", F.array().cast("array<struct<a:bigint,b:bigint,ks:array<int>>>")))
    done = joined.select(ROW, cut.alias("cut"))
    return unpack(done, df.columns, n_words=F.col("cut.n_words"), n_removed=F.col("cut.n_removed"), kept_text=F.col("cut.kept"))
