"""Benchmark decontamination with a generalised suffix automaton of the benchmark items.

Items are normalised to words; every item is added to one automaton over word numbers, so any run
of words of any item is a path from its start. The words of a document stream through it, keeping
the longest match that ends at each word. Where that match is at least ``window`` words long, a
window of some item ends; an item of fewer words is a window as a whole and is found through the
suffix links. Spans of covered words that exceed the length limit can then be cut from the text,
and texts whose coverage exceeds a limit dropped.

The automaton is made on the driver in blocks of ``block_words`` item words, read block by block: that
is the proven bound of what the driver holds and sends to tasks. A benchmark of one block is one
row-local pass. A larger one takes more passes, not more memory: each block is a pass of its own, which
writes what it found in each different text with hits (few rows, by a digest of the text) before the
next block's automaton is made and its own is given up; the findings then join the rows. Items that
end windows in a state are not listed there but are a range of the suffix tree's order, so boilerplate
that many items share takes no more room. Words that no item has break every match, so only runs of
known words long enough for a window are streamed.

Defined results: null texts and null items have no words; no words, no windows; a null item id is
listed as ``null``; item ids are compared as strings and items with the same id count once; repeated
documents are judged each; result columns replace input columns of their names; an empty benchmark
or an empty table gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import ROW, find_words, lower_table, materialise, pack, text_or_empty, text_slices, unpack, word_table

WINDOW = 10
#: Words of benchmark items that one automaton holds, about 1 kB each.
BLOCK_WORDS = 200_000

_KIND = word_table("alnum")
_LOWER = lower_table()

SPANS = "array<struct<first:bigint,last:bigint,char_start:bigint,char_end:bigint>>"
RESULT = f"struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:{SPANS}>"


def words_of(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = find_words(raw, np.array([0, len(raw)]), _KIND)
    data = _LOWER[raw].tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        self.least = window
        ends: list[tuple[int, int]] = []  # states in which a prefix of an item ends, and the item
        whole: dict[int, list[int]] = {}  # short items that end in a state
        for item, words in items:
            if words:
                self._add(item, words, ends, whole)
        self._close(ends, whole)

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if word in nexts[last]:
            q = nexts[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new, p = self._state(length[last] + 1), last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _add(self, item: str, words: list[bytes], ends: list[tuple[int, int]], whole: dict[int, list[int]]) -> None:
        last, number, name = 0, self.number, len(self.names)
        self.names.append(item)
        for word in words:
            last = self._extend(last, number.setdefault(word, len(number)))
            ends.append((last, name))
        if len(words) < self.window:
            whole.setdefault(last, []).append(name)
            self.least = min(self.least, len(words))

    def _close(self, ends: list[tuple[int, int]], whole: dict[int, list[int]]) -> None:
        """Number the states so that those whose words end with a state's are a range; short items go down to all that end with them."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        below = [1] * len(self.link)
        for v in reversed(order):
            below[self.link[v]] += below[v]
        first, free = [0] * len(self.link), [1] * len(self.link)
        #: For each state the (size, items) of short items that its words end with; states without own ones share their parent's.
        self.shorter: list[tuple[tuple[int, list[int]], ...]] = [()] * len(self.link)
        for v in order:
            up = self.link[v]
            first[v] = free[up]
            free[up] += below[v]
            free[v] = first[v] + 1
            self.shorter[v] = (*self.shorter[up], (self.length[v], whole[v])) if v in whole else self.shorter[up]
        self.first, self.below = np.array(first), np.array(below)
        at = np.array([first[v] for v, _ in ends], np.int64)
        by = np.argsort(at, kind="stable")
        self.end_at, self.end_of = at[by], np.array([n for _, n in ends], np.int32)[by]

    def owners(self, state: int) -> np.ndarray:
        """The items that hold the words of a state."""
        lo, hi = np.searchsorted(self.end_at, [self.first[state], self.first[state] + self.below[state]])
        return np.unique(self.end_of[lo:hi])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def scan(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [first, last) of covered words, and the items whose windows occur."""
        known = np.flatnonzero(numbers >= 0)
        if len(known) < self.least:
            return [], set()
        breaks = np.flatnonzero(np.diff(known) > 1) + 1
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        short: dict[int, list[int]] = {}
        for first, end in zip(known[np.r_[0, breaks]].tolist(), (known[np.r_[breaks - 1, len(known) - 1]] + 1).tolist(), strict=True):
            if end - first >= self.least:
                self._stream(numbers[first:end].tolist(), first, spans, states, short)
        items = {self.names[n] for listed in short.values() for n in listed}
        for v in states:
            items.update(self.names[n] for n in self.owners(v).tolist())
        return spans, items

    def _stream(self, run: list[int], first: int, spans: list[tuple[int, int]], states: set[int], short: dict[int, list[int]]) -> None:
        nexts, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, word in enumerate(run, first + 1):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state, matched = nexts[state][word], matched + 1
            covered = 0
            if matched >= window:
                covered, v = window, state
                while length[link[v]] >= window:
                    v = link[v]
                states.add(v)
            for size, listed in self.shorter[state]:
                if size <= matched:
                    covered = max(covered, size)
                    short[id(listed)] = listed
            if covered:
                if spans and spans[-1][1] >= i - covered:
                    begin = spans.pop()[0]
                    while spans and spans[-1][1] >= min(begin, i - covered):
                        begin = min(spans.pop()[0], begin)
                    spans.append((min(begin, i - covered), i))
                else:
                    spans.append((i - covered, i))


def _matcher(automaton):
    """Not deterministic in name, so that Spark runs it once even where its result is filtered on."""

    @F.arrow_udf(RESULT)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _match(automaton, batches)

    return match.asNondeterministic()


def _match(automaton, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    held = automaton.value
    for batch in batches:
        out = []
        for _, _, raw, off in text_slices(batch):
            starts, ends, firsts = find_words(raw, off, _KIND)
            data = _LOWER[raw].tobytes()
            numbers = held.numbers([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            for k in range(len(off) - 1):
                a, b = int(firsts[k]), int(firsts[k + 1])
                spans, items = held.scan(numbers[a:b])
                begin = int(off[k])
                cut = []
                for p, q in spans:
                    head = raw[begin : starts[a + p]].tobytes().decode()
                    body = raw[starts[a + p] : ends[a + q - 1]].tobytes().decode()
                    cut.append({"first": p, "last": q - 1, "char_start": len(head), "char_end": len(head) + len(body)})
                out.append({"n_words": b - a, "n_hit": sum(q - p for p, q in spans), "items": sorted(items), "spans": cut})
        yield pa.array(out, _ARROW)


_ARROW = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "char_start", "char_end")])))]
)


def _pieces(words: list[bytes], window: int, most: int) -> Iterator[list[bytes]]:
    """An item's words, or if they are more than ``most`` pieces that overlap by a window less one word, so that each window is in one."""
    most = max(most, 2 * window)
    if len(words) <= most:
        yield words
        return
    for at in range(0, len(words) - window + 1, most - window + 1):
        yield words[at : at + most]


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Blocks of items, or of pieces of long ones, with at most ``block_words`` words; partition by partition, never the whole table."""
    block, size = [], 0
    for row in items.select(F.col(f"`{item_id}`").cast("string").alias("i"), text_or_empty(text).alias("t")).toLocalIterator():
        for words in _pieces(words_of(row["t"]), window, block_words):
            if size and size + len(words) > block_words:
                yield block
                block, size = [], 0
            block.append((row["i"] if row["i"] is not None else "null", words))
            size += len(words)
    yield block


def find(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``spans`` of covered words and characters."""
    sent = lambda block: df.sparkSession.sparkContext.broadcast(Automaton(block, window))
    blocks = _blocks(items, item_id, item_text, block_words, window)
    first, second = next(blocks), next(blocks, None)
    rows = pack(df, text=text_or_empty(text))
    if second is None:
        found = rows.select(ROW, _matcher(sent(first))(F.col("text")).alias("found"))
    else:
        digest, passes = F.sha2(F.encode("text", "utf-8"), 256).alias("digest"), []
        for block in chain([first, second], blocks):
            automaton = sent(block)
            hits = rows.select(digest, _matcher(automaton)(F.col("text")).alias("hit")).where("hit.n_hit > 0")
            passes.append(materialise(hits.groupBy("digest").agg(F.first("hit").alias("hit")), "benchmark-hits"))
            automaton.destroy()
        hits = reduce(DataFrame.unionAll, passes).groupBy("digest").agg(F.collect_list("hit").alias("hits"))
        hits = hits.select("digest", F.aggregate(F.slice("hits", 2, F.greatest(F.size("hits") - 1, F.lit(1))), F.get("hits", F.lit(0)), _merged).alias("hit"))
        counted = rows.select(ROW, digest, _matcher(sent([]))(F.col("text")).alias("none"))
        found = counted.join(hits, "digest", "left").select(ROW, F.coalesce("hit", "none").alias("found"))
    return unpack(found, df.columns, **{c: F.col(f"found.{c}") for c in ("n_words", "n_hit", "items", "spans")})


def _merged(a: Column, b: Column) -> Column:
    """Two blocks' findings as one: item lists united, overlapping or touching spans joined."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["char_start"].alias("char_start"), F.greatest(last["char_end"], x["char_end"]).alias("char_end")
        )
        meets = (F.size(acc) > 0) & (x["first"] <= last["last"] + 1)
        return F.when(meets, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    spans = F.aggregate(F.array_sort(F.concat(a["spans"], b["spans"])), F.array().cast(SPANS), step)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return F.struct(
        a["n_words"].alias("n_words"), hit.alias("n_hit"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"), spans.alias("spans")
    )


def clean(df: DataFrame, items: DataFrame, text: str = "text", min_span: int = 1, max_coverage: float = 0.5, **options) -> DataFrame:
    """``df`` without what is contaminated, in its own columns.

    Spans of at least ``min_span`` covered words are cut from the text; a row whose covered words
    make up more than ``max_coverage`` of all its words is dropped. Rows without such spans keep
    their text unchanged, null included.
    """
    packed = pack(df, __text=F.col(f"`{text}`"))
    found = find(packed, items, text="__text", **options)
    spans = F.filter("spans", lambda s: s["last"] - s["first"] + 1 >= min_span)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["char_end"]))
    starts = F.concat(F.transform(spans, lambda s: s["char_start"]), F.array(F.length("__text").cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("__text"), (a + 1).cast("int"), (b - a).cast("int")))
    cut = F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(F.col("__text"))
    kept = found.where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    order = df.columns
    return unpack(kept, order, **{text: cut}).select(*[F.col(f"`{c}`") for c in order])
