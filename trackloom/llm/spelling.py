"""Spelling variants: words that differ by one letter, found by two-dimensional range reporting on wavelet trees.

Sort words forwards, and sort them by their reversed spelling. The words that begin with ``p`` are an interval
of the first order, those that end with ``s`` one of the second; a word that a letter at place i was replaced,
left out or added in begins with the first i letters of the other and ends with what follows its letter. So
each place of each word is one rectangle among points (forward rank, reverse rank), and the points in it are
reported by a wavelet tree over the reverse ranks in forward order, for all rectangles of a block at once,
level by level. The place is the first at which two words differ, so a pair is found at one place only.

No task sees all words. Both orders are cut into blocks by bounds from a sample of at most ``SAMPLE`` words.
Places from a word's ``h``-th letter on are searched in the forward blocks that its first h letters can stand
in, those before in the reverse blocks of the rest; h is the letter for which these are fewest blocks, so a
beginning or an ending that many words share sends them to few blocks all the same. A block holds its words
and streams those that look something up in it, and works on sub-blocks of at most ``CELLS`` letters, so words
of any length and any number of words with one beginning are taken. A block returns a count and the best of
its words for each word looked up, never pairs.

Words are runs of letters from U+0041 to U+00FF, counted after some of them lose a letter by a rule of the
document and the run (``corrupted``); counts are summed in each task before they are shuffled.

Defined results: null text has no words; a null id counts as empty in that rule; repeated rows count each;
equal counts are decided by the order of code points; other columns are not looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import discard_made, materialise, recorded

LEAST = 7
#: Words of a block, at least and at most, and sampled words for its bounds.
SMALL_BLOCK, BLOCK = 8192, 65_536
SAMPLE = 65_536
#: Letters of a bound; a longer word's first ones decide.
BOUND = 256
#: Letters that a block works on at once, and words that it counts before they leave the task.
CELLS = 1 << 21
HELD = 300_000

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)
_LOWER = {c: c + 32 for c in range(65, 91)}


# ---------------------------------------------------------------- words

def corrupted(key: str, run: str, every: int = 31) -> str:
    """The lower-cased run, less one letter if ``every`` divides the checksum of key and run."""
    h = crc32(f"{key}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words_of(key: str, text: str, least: int = LEAST) -> Counter:
    """Words of at least ``least`` letters of a text, with their numbers."""
    found: Counter = Counter()
    for run, n in Counter(_RUN.findall(text)).items():
        word = corrupted(key, run.lower() if run.isascii() else run.translate(_LOWER))
        if len(word) >= least:
            found[word] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            total.update(words_of(key.as_py(), text.as_py()))
            if len(total) >= HELD:
                yield out()
                total.clear()
    yield out()


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of ``df``."""
    texts = df.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- rectangles

class Wavelet:
    """A wavelet tree over a permutation, as one bit vector with ranks for each level."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for level in range(self.bits - 1, -1, -1):
            one = (values >> level) & 1
            ones = np.concatenate([[0], np.cumsum(one)]).astype(np.int32)
            self.levels.append((level, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of the values from c to d (exclusive) at the places from a to b."""
        q = np.flatnonzero((a < b) & (c < d))
        a, b, low = a[q], b[q], np.zeros(len(q), np.int64)
        for level, ones, zeros in self.levels:
            oa, ob = ones[a], ones[b]
            middle = low + (1 << level)
            left = (a - oa < b - ob) & (c[q] < middle)  # values below the middle keep their order at the front
            right = (oa < ob) & (d[q] > middle)
            q, a, b, low = (
                np.concatenate([q[left], q[right]]),
                np.concatenate([(a - oa)[left], (zeros + oa)[right]]),
                np.concatenate([(b - ob)[left], (zeros + ob)[right]]),
                np.concatenate([low[left], middle[right]]),
            )
            inside = (low < d[q]) & (low + (1 << level) > c[q])
            q, a, b, low = q[inside], a[inside], b[inside], low[inside]
        return q, low


def _letters(words: list[bytes], width: int) -> np.ndarray:
    """A row of letters for each word, filled up with zeros."""
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)


class Order:
    """Words sorted by their letters: each one's place, and the interval of those with the same first i letters, counted in points."""

    def __init__(self, letters: np.ndarray, point: np.ndarray):
        n, width = letters.shape
        self.order = np.argsort(np.ascontiguousarray(letters).view(f"S{width}").ravel(), kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        held = letters[self.order]
        other = held[1:] != held[:-1]
        self.common = np.where(other.any(1), other.argmax(1), width) if n > 1 else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(point[self.order])])

    def interval(self, rows: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) point with the first ``i`` letters of each of ``rows``."""
        edges = np.concatenate([[0], np.flatnonzero(self.common < i) + 1, [len(self.order)]])
        k = np.searchsorted(edges, self.place[rows], side="right")
        return self.before[edges[k - 1]], self.before[edges[k]]


def near(words: list[bytes], length: int, asking: list[bytes], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking word, word) of all of ``words``, which have ``length`` letters, that differ from one asking by one letter at a place from ``first`` to ``last``."""
    m, k, width = len(words), len(asking), length + 1
    letters = np.concatenate([_letters(words, width), _letters(asking, width)])
    size = np.concatenate([np.full(m, length), np.array([len(w) for w in asking], np.int64)])
    at = size[:, None] - 1 - np.arange(width)
    turned = np.where(at >= 0, np.take_along_axis(letters, np.maximum(at, 0), 1), 0).astype(np.uint8)
    point = np.arange(m + k) < m
    ahead, back = Order(letters, point), Order(turned, point)
    ranks, points = back.before[back.place[:m]], ahead.order[ahead.order < m]
    by_rank = back.order[back.order < m]
    tree = Wavelet(ranks[points])
    rows, out = m + np.arange(k), ([], [])
    own = size[rows]
    for i in range(int(first.min(initial=width)), min(int(last.max(initial=-1)), length) + 1):
        ending = length - i - (own <= length)  # letters after the place: of a longer word all but its own letter, of a shorter one all, as what is added has gone
        ending = np.where(own < length, own - i, ending)
        open_ = np.flatnonzero((first <= i) & (i <= last) & (ending >= 0) & (i <= own))
        a, b = ahead.interval(rows[open_], i)
        open_, a, b = (x[b > a] for x in (open_, a, b))
        for j in np.unique(ending[open_]):
            these = ending[open_] == j
            asked = open_[these]
            c, d = back.interval(rows[asked], int(j))
            q, value = tree.report(a[these], b[these], c, d)
            found = by_rank[value]
            differ = letters[found, i] != letters[rows[asked[q]], i]
            out[0].append(asked[q[differ]])
            out[1].append(found[differ])
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in out)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) of each word that a unit's words were looked up for, from rows (unit, query, word, n, split)."""
    unit, blocks, held = None, {}, []

    def build() -> dict[int, list[tuple[list[bytes], np.ndarray, np.ndarray]]]:
        """Sub-blocks of the held words by length: the words, their numbers, and their ranks by number."""
        table = pa.Table.from_batches(held)
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        for w, n in zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True):
            by_length.setdefault(len(w), []).append((w.encode("latin-1"), n))
        out: dict[int, list] = {}
        for length, listed in by_length.items():
            step = max(1, CELLS // (length + 1))
            for at in range(0, len(listed), step):
                part = listed[at : at + step]
                order = sorted(range(len(part)), key=lambda i: (-part[i][1], part[i][0]))
                rank = np.empty(len(part), np.int64)
                rank[order] = np.arange(len(part))
                out.setdefault(length, []).append(([w for w, _ in part], rank, np.array(order)))
        return out

    def answer(part: pa.RecordBatch, numbers: dict) -> pa.RecordBatch | None:
        forward = unit % 2 == 0
        words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
        split = part.column("split").to_numpy()
        size = np.array([len(w) for w in words], np.int64)
        count, best = np.zeros(len(words), np.int64), [None] * len(words)
        for length, subs in blocks.items():
            fits = np.flatnonzero(np.abs(size - length) <= 1)
            step = max(1, CELLS // (length + 1))
            for at in range(0, len(fits), step):
                chosen = fits[at : at + step]
                asking = [words[i] for i in chosen]
                h = split[chosen]
                first, last = (h, np.full(len(h), length + 1)) if forward else (np.zeros(len(h), np.int64), h - 1)
                for listed, rank, order in subs:
                    asked, found = near(listed, length, asking, first, last)
                    if not len(asked):
                        continue
                    count[chosen] += np.bincount(asked, minlength=len(chosen))
                    top = np.full(len(chosen), len(listed), np.int64)
                    np.minimum.at(top, asked, rank[found])
                    for q in np.flatnonzero(top < len(listed)):
                        w = listed[order[top[q]]]
                        best[chosen[q]] = min(best[chosen[q]] or (0, b""), (-numbers[w], w))
        hit = np.flatnonzero(count)
        if not len(hit):
            return None
        texts = part.column("word").take(pa.array(hit))
        return pa.RecordBatch.from_arrays(
            [texts, pa.array(count[hit]), pa.array([-best[i][0] for i in hit], pa.int64()), pa.array([best[i][1].decode("latin-1") for i in hit], pa.string())], ["word", "n_near", "best_n", "best"]
        )

    numbers: dict[bytes, int] = {}
    for batch in batches:
        units, query = batch.column("unit").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(units) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(units)], strict=True):
            part = batch.slice(a, b - a)
            if units[a] != unit:
                unit, blocks, held, numbers = units[a], {}, [], {}
            if not query[a]:
                held.append(part)
                continue
            if held:
                blocks = build()
                numbers = {w.encode("latin-1"): n for p in held for w, n in zip(p.column("word").to_pylist(), p.column("n").to_pylist(), strict=True)}
                held = []
            if blocks and (out := answer(part, numbers)) is not None:
                yield out


def bounds_of(words: DataFrame, block: int, total: int) -> tuple[list[str], list[str]]:
    """Bounds of the forward and of the reverse blocks, from a bounded sample."""
    blocks = -(-total // block)
    if blocks < 2:
        return [], []
    share = words.where(F.pmod(F.xxhash64("word"), F.lit(total)) < SAMPLE // 2).limit(SAMPLE)
    sample = share.select(F.substring("word", 1, BOUND).alias("a"), F.substring(F.reverse("word"), 1, BOUND).alias("b")).collect()
    out = []
    for side in ("a", "b"):
        ordered = sorted(r[side] for r in sample)
        out.append(sorted({ordered[len(ordered) * i // blocks] for i in range(1, blocks)}) if ordered else [])
    return out[0], out[1]


def _spanned(bounds: list[str], start: str) -> tuple[int, int]:
    """First and last block in which words that begin with ``start`` can stand."""
    return bisect_right(bounds, start), bisect_left(bounds, start + "\U0010ffff")


def neighbours(words: DataFrame, block: int | None = None) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n), each word once, that have near ones: how many, and the one of the largest n."""
    spark = words.sparkSession
    total = words.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = block or min(BLOCK, max(SMALL_BLOCK, -(-total // (4 * parts))))
    forward, backward = bounds_of(words, block, max(total, 1))
    sent = spark.sparkContext.broadcast((forward, backward))

    @F.arrow_udf("struct<home:array<bigint>,split:int,units:array<bigint>>")
    def route(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ahead, back = sent.value
        for batch in batches:
            out = []
            for w in batch.to_pylist():
                turned, best = w[::-1], None
                middle = len(w) // 2
                for h in (middle, *(x for d in range(1, min(middle, 32)) for x in (middle - d, middle + d))):
                    spans = _spanned(ahead, w[:h]), _spanned(back, turned[: len(w) - h])
                    cost = sum(b - a + 1 for a, b in spans)
                    if best is None or cost < best[0]:
                        best = cost, h, spans
                    if cost == 2:
                        break
                _, h, ((a, b), (c, d)) = best
                out.append({"home": [2 * bisect_right(ahead, w), 2 * bisect_right(back, turned) + 1], "split": h, "units": [*(2 * u for u in range(a, b + 1)), *(2 * u + 1 for u in range(c, d + 1))]})
            yield pa.array(out, pa.struct([("home", pa.list_(pa.int64())), ("split", pa.int32()), ("units", pa.list_(pa.int64()))]))

    routed = materialise(words.select("word", "n", route("word").alias("to")), "routed")
    given = routed.select(F.explode("to.home").alias("unit"), F.lit(False).alias("query"), "word", "n", F.lit(0).alias("split"))
    asked = routed.select(F.explode("to.units").alias("unit"), F.lit(True).alias("query"), "word", "n", F.col("to.split").alias("split"))
    units = 2 * max(len(forward), len(backward)) + 2
    dealt = given.unionAll(asked).repartition(max(1, min(units, 20_000)), "unit").sortWithinPartitions("unit", "query")
    found = dealt.mapInArrow(_looked_up, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.w").alias("best"))


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", least_n: int = 2, times: int = 10, block: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of ``df`` that occur ``least_n`` times, each with the near word it is a variant of.

    ``form`` is the near word of the largest n if that is at least ``times`` the word's; ``root`` is where forms lead to.
    """
    with recorded() as made:
        words = materialise(count_words(df, key, text).where(F.col("n") >= least_n), "words")
        found = materialise(neighbours(words, block), "near")
        rows = words.join(found, "word", "left")
        formed = F.col("best_n") >= times * F.col("n")
        rows = rows.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n"))
        rows = materialise(rows, "forms")
        discard_made(df.sparkSession, made, rows)
        links = rows.where("form is not null").select("word", F.col("form").alias("root"))
        while True:  # the way to the root is halved in each round; n grows along it, so it ends
            further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
            stepped = materialise(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
            discard_made(df.sparkSession, made, rows, stepped)
            links = stepped.select("word", "root")
            if stepped.where("moved").isEmpty():
                break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
