"""N-gram Jaccard join by chosen paths.

A text is the set of its runs of ``size`` words. In each run of the join every set picks the members
whose hash falls below ``PICKS`` / its size, so similar sets pick mostly the same ones. Sets that
picked a common member fall into one bucket. A bucket of at most ``small`` sets is compared by brute
force. A larger one is split: its sets pick again, by hashes of the next level, and those with a common
pick fall into a smaller bucket, up to ``DEPTH`` times. Where that would not make smaller buckets, as in a
group of near copies, which share most picks on any level, the bucket is compared by brute force in
blocks, so no bucket and no pair of one is dropped; whether it would is estimated from some ``TRIAL`` of its
sets. Large buckets with common sets become one bucket where that makes less work. Buckets of few but large sets
count as larger, so that a task holds a bounded number of runs. The runs have hashes of their own. Pairs
that share enough picks are then verified on their whole sets; the number of runs and the share that is
enough follow together from the target recall, by the chance that a pair at the threshold shares too few
(``miss_chance``) or loses its path in a split (``split_chance``).

No pair leaves its bucket. Two sets that meet in several buckets are judged in the one whose name is
the smallest, which both know as they carry the names of all theirs. A first pass over the buckets
keeps the rows that have a pair to be judged there; only these are joined with their texts, and a
second pass counts each row's links and names the smallest row it is connected to: the result is
one row for a set and bucket, however many pairs a group of near copies has.

Texts with equal sets are one class and are joined once, whatever the number of copies. Groups of
links (connected components) are found by label propagation with pointer jumping, each round a
table in the shared folder.

Defined results: null text counts as empty; a text of 1 to ``size`` - 1 words is one run of all of
them; texts without words form one class of their own (similarity 1 to each other, 0 to others);
repeated rows are members of one class; ties keep the smallest key, null keys come last; an empty
table gives an empty result. The result carries no other columns than the key; ``dedup`` does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import discard_made, find_words, lower_table, materialise, mix, pack, range_hasher, recorded, text_identity, text_or_empty, text_slices, unpack, word_hashes, word_table

SIZE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
PICKS = 8
SMALL = 2048
#: Buckets of at most so many sets are compared many at once.
TINY = 48
#: Values, or pairs of values, that one numpy step takes at once.
STEP = 2_000_000
#: Times that a large bucket may be split, and sets of it that tell whether that helps.
DEPTH = 2
TRIAL = 256
#: Members of sets that count as one set of a bucket at least.
MEMBERS = 4000
#: Rows of a table of buckets that may be broadcast.
FEW = 100_000
#: Low bits of a pick that hold its run.
RUN_BITS = 15
#: Shares of the larger sample that a pair may have to have in common to be verified.
SHARES = (0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)

_ALNUM, _LOWER = word_table("alnum"), lower_table()
_BASE = 0xD1342543DE82EF95 | 1


def miss_chance(threshold: float, runs: int, share: float) -> float:
    """Chance that a pair at the threshold shares no pick, or less than ``share`` of the picks of either set.

    Taken for the worst sizes, a set and itself with more members: of the picks of each set, the share
    in common is then the threshold, and it is larger for all other sizes. Numbers of picks are taken
    as Poisson; those of small sets vary less.
    """
    mean = runs * PICKS
    most = math.ceil(mean + 12 * math.sqrt(mean) + 12)

    def chances(m: float) -> np.ndarray:
        return np.array([math.exp(k * math.log(m) - m - math.lgamma(k + 1)) if m else float(k == 0) for k in range(most + 1)])

    both, own = chances(mean * threshold), np.cumsum(chances(mean * (1 - threshold)))
    kept = sum(both[k] * own[min(most, math.floor(k / share + 1e-9) - k)] ** 2 for k in range(1, most + 1))
    return float(max(0.0, 1 - kept))


def split_chance(threshold: float, runs: int) -> float:
    """Chance that a pair at the threshold shares no pick in some of the splits, for the worst sizes: those of ``miss_chance``."""
    return DEPTH * math.exp(-runs * PICKS * threshold)


def runs_and_share(threshold: float, target: float) -> tuple[int, float]:
    """The fewest runs, and the largest share of common picks, with which a pair at the threshold is missed with a chance of at most 1 - ``target``."""
    for runs in range(1, RUN_BITS + 2):
        for share in SHARES:
            if miss_chance(threshold, runs, share) + split_chance(threshold, runs) <= 1 - target:
                return runs, share
    raise ValueError(f"a recall of {target} at {threshold} needs more than {RUN_BITS + 1} runs")


def word_runs(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word runs of each text of a slice, sorted by text and hash, and the text of each."""
    starts, ends, firsts = find_words(raw, off, _ALNUM)
    names = word_hashes(_LOWER[raw], starts, ends)
    words = np.diff(firsts)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    text = np.repeat(np.arange(len(words)), count)
    first = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + firsts[:-1][text]
    runs = mix(range_hasher(names, _BASE)(first, first + np.minimum(words[text], size)), 83)
    order = np.lexsort((runs, text))
    runs, text = runs[order], text[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    return runs[new], text[new]


_SKETCH = pa.struct([("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), *[(f"picks{level}", pa.list_(pa.int64())) for level in range(DEPTH + 1)]])
SKETCH = "struct<n:bigint,s1:bigint,s2:bigint," + ",".join(f"picks{level}:array<bigint>" for level in range(DEPTH + 1)) + ">"


def _sketcher(size: int, runs: int):
    def picked(members: np.ndarray, text: np.ndarray, n: np.ndarray, level: int) -> pa.ListArray:
        bar = np.minimum(PICKS / np.maximum(n, 1), 1.0) * 2.0**53
        found, owner = [], []
        for run in range(runs):
            chance = mix(members, 200 + run + 100 * level)
            below = np.flatnonzero((chance >> np.uint64(11)).astype(np.float64) < bar[text])
            order = below[np.lexsort((chance[below], text[below]))]
            # the run goes into the lowest bits, so picks of different runs never meet
            found.append((mix(members[order], 300 + level) & ~np.uint64(RUN_BITS)) | np.uint64(run))
            owner.append(text[order])
        found, owner = np.concatenate(found), np.concatenate(owner)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[np.argsort(owner, kind="stable")].view(np.int64)))

    @F.arrow_udf(SKETCH)
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([], _SKETCH)]
            for lo, hi, raw, off in text_slices(batch):
                members, text = word_runs(raw, off, size)
                n = np.bincount(text, minlength=hi - lo)
                edge = np.concatenate([[0], np.cumsum(n)])
                sums = []
                for lane in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members, 100 + lane))])
                    sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
                parts.append(pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), *map(pa.array, sums), *(picked(members, text, n, level) for level in range(DEPTH + 1))], fields=list(_SKETCH)))
            yield pa.concat_arrays(parts)

    return sketch


def _expanded(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``first[i]``, ``first[i] + 1``, ... of which there are ``n[i]``, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Lists:
    """Lists of values of some rows, the values numbered so that rows and numbers sort together."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.offsets, self.values = offsets, flat
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        distinct, number = np.unique(flat, return_inverse=True)
        self.number, self.span = number.astype(np.int64), len(distinct) + 1
        self.keys = np.sort(self.row * self.span + self.number)

    @classmethod
    def of(cls, column: pa.Array) -> Lists:
        return cls(column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())]))

    def common(self, left: np.ndarray, right: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
        """How many values the rows ``left[i]`` and ``right[i]`` share; of the left ones only those that are ``counted``."""
        size = self.offsets[left + 1] - self.offsets[left]
        out = np.zeros(len(left), np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(left):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + STEP, side="right")) - 1)
            at, n = _expanded(self.offsets[left[lo:hi]], size[lo:hi]), size[lo:hi]
            wanted = np.repeat(right[lo:hi], n) * self.span + self.number[at]
            found = np.searchsorted(self.keys, wanted)
            hit = self.keys[np.minimum(found, len(self.keys) - 1)] == wanted if len(self.keys) else np.zeros(0, bool)
            if counted is not None:
                hit &= counted[at]
            out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n), hit, minlength=hi - lo)
            lo = hi
        return out

    def common_matrix(self, a: int, b: int, counted: np.ndarray | None = None) -> np.ndarray:
        """The same for any two of the rows [a, b): frequent values by a matrix product, the others by their few pairs."""
        m, part = b - a, slice(int(self.offsets[a]), int(self.offsets[b]))
        row, number = self.row[part] - a, self.number[part]
        if counted is not None:
            row, number = row[counted[part]], number[counted[part]]
        _, column, count = np.unique(number, return_inverse=True, return_counts=True)
        total = np.zeros((m, m), np.float32)
        often = np.flatnonzero(count > max(8, m // 16))
        place = np.full(len(count), -1)
        place[often] = np.arange(len(often))
        at = place[column]
        for lo in range(0, len(often), 512):
            mine = (at >= lo) & (at < lo + 512)
            one = np.zeros((m, min(512, len(often) - lo)), np.float32)
            one[row[mine], at[mine] - lo] = 1
            total += one @ one.T
        few = np.flatnonzero((at < 0) & (count[column] > 1))
        few = few[np.argsort(column[few], kind="stable")]
        row, column = row[few], column[few]
        first = np.flatnonzero(np.diff(np.r_[-1, column]))
        ahead = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        edge, lo = np.concatenate([[0], np.cumsum(ahead)]), 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + STEP, side="right")) - 1)
            right = np.repeat(np.arange(lo, hi), ahead[lo:hi])
            left = _expanded(np.arange(lo, hi) - ahead[lo:hi], ahead[lo:hi])
            found = np.bincount(row[right] * m + row[left], minlength=m * m).reshape(m, m)
            total += found + found.T
            lo = hi
        return total


class Buckets:
    """Rows sorted by bucket (unit, node, side, n, count, picks, leaves), and the pairs that each bucket has to judge."""

    def __init__(self, rows: pa.Table, threshold: float, share: float):
        rows = rows.combine_chunks()
        self.threshold, self.share, self.rows = threshold, share, len(rows)
        self.node, self.side, self.n, self.count = (rows[c].to_numpy() for c in ("node", "side", "n", "count"))
        unit = rows["unit"].to_numpy()
        edge = np.flatnonzero(np.diff(unit)) + 1
        self.first, self.end = np.r_[0, edge], np.r_[edge, len(unit)]
        self.picks, self.leaves = (Lists.of(_one(rows[c])) for c in ("picks", "leaves"))
        self.earlier = self.leaves.values < self.node[self.leaves.row]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int] | None]]:
        """(left, right, rows of the one large bucket, or None): pairs whose sizes allow the threshold, that share enough
        picks, and that no other bucket judges: of all the leaves two sets share, the smallest is theirs."""
        size = self.end - self.first
        large = size > TINY
        start = np.repeat(self.first, size)
        ahead = np.where(np.repeat(large, size), 0, np.arange(self.rows) - start)
        edge, lo = np.concatenate([[0], np.cumsum(ahead)]), 0
        while lo < self.rows:
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + STEP, side="right")) - 1)
            right = np.repeat(np.arange(lo, hi), ahead[lo:hi])
            left = _expanded(start[lo:hi], ahead[lo:hi])
            ok = self._sized(left, right)
            left, right = left[ok], right[ok]
            ok = self.picks.common(left, right) >= self.share * np.maximum(self.count[left], self.count[right])
            left, right = left[ok], right[ok]
            ok = self.leaves.common(left, right, self.earlier) == 0
            yield left[ok], right[ok], None
            lo = hi
        for a, b in zip(self.first[large].tolist(), self.end[large].tolist(), strict=True):
            shared = self.picks.common_matrix(a, b)
            shared[self.leaves.common_matrix(a, b, self.earlier) > 0] = 0
            left, right = np.nonzero(np.tril(shared, -1))
            enough = shared[left, right] >= self.share * np.maximum(self.count[a + left], self.count[a + right])
            left, right = a + left[enough], a + right[enough]
            ok = self._sized(left, right)
            yield left[ok], right[ok], (a, b)

    def _sized(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        small, large = np.minimum(self.n[left], self.n[right]), np.maximum(self.n[left], self.n[right])
        across = (self.side[left] < 0) | (self.side[left] != self.side[right])
        return across & (small >= self.threshold * large)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _whole_buckets(work):
    """``work`` on tables of whole buckets from rows that are sorted by ``unit``; one bucket at most waits for its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            unit = batch["unit"].to_numpy()
            cut = int(np.flatnonzero(unit == unit[-1])[0])
            if waiting and (cut or waiting[-1]["unit"][0].as_py() != unit[0]):
                own = int(np.flatnonzero(unit != waiting[-1]["unit"][0].as_py())[0]) if unit[0] == waiting[-1]["unit"][0].as_py() else 0
                yield from work(pa.Table.from_batches([*waiting, batch.slice(0, own)]))
                waiting, batch, cut = [], batch.slice(own), cut - own
            if cut > 0:
                yield from work(pa.Table.from_batches([batch.slice(0, cut)]))
                batch = batch.slice(cut)
            waiting.append(batch)
        if waiting:
            yield from work(pa.Table.from_batches(waiting))

    return run


def _promising(threshold: float, share: float):
    """Of each bucket the rows that have a pair to be verified there."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(rows), bool)
        for left, right, _ in Buckets(rows, threshold, share).pairs():
            held[left] = held[right] = True
        yield from rows.filter(pa.array(held)).to_batches()

    return _whole_buckets(work)


_FOUND = pa.schema([("cid", pa.int64()), ("root", pa.int64()), ("linked", pa.int64())])


def _verified(threshold: float, share: float, size: int):
    """For each row of a bucket with links there: the smallest id it is connected to, and how many texts it is linked with."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        held = Buckets(rows, threshold, share)
        members, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi, raw, off in text_slices(rows["text"]):
            found, text = word_runs(raw, off, size)
            members.append(found)
            count.append(np.bincount(text, minlength=hi - lo))
        length = np.concatenate(count)
        sets = Lists(np.concatenate(members), np.concatenate([[0], np.cumsum(length)]))
        del members
        cid, copies = rows["cid"].to_numpy(), rows["members"].to_numpy()
        linked, root = np.zeros(len(rows), np.int64), cid.copy()
        for left, right, bounds in held.pairs():
            if bounds is None:
                same = sets.common(left, right)
            else:
                same = sets.common_matrix(*bounds)[left - bounds[0], right - bounds[0]].astype(np.int64)
            ok = same >= threshold * (length[left] + length[right] - same)
            left, right = left[ok], right[ok]
            linked += np.bincount(left, copies[right], len(rows)).astype(np.int64) + np.bincount(right, copies[left], len(rows)).astype(np.int64)
            while len(left) and (root[left] != root[right]).any():
                least = np.minimum(root[left], root[right])
                np.minimum.at(root, left, least)
                np.minimum.at(root, right, least)
        with_links = np.flatnonzero(linked)
        yield pa.RecordBatch.from_arrays([pa.array(x[with_links]) for x in (cid, root, linked)], schema=_FOUND)

    return _whole_buckets(work)


def _large():
    """How large a bucket counts: its sets, or the members of them if those are many."""
    return F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") / MEMBERS))


def _blocks(m, small: int):
    return F.ceil(m / (small / 2)).cast("int")


def _few(table: DataFrame) -> DataFrame:
    """A written table, to be sent to all tasks if it has at most ``FEW`` (short) rows, so that a hot key of the other side stays where it is."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def _joined(large: DataFrame, small: int) -> DataFrame:
    """(cid, n, node, m) of large buckets (cid, n, node, m): those connected by common sets are one where that makes fewer rows, and so fewer pairs."""
    first = large.groupBy("cid").agg(F.min("node").alias("a"))
    roots = components(large.join(first, "cid").select("a", F.col("node").alias("b")).where("a <> b").distinct())
    named = large.join(_few(roots).withColumnRenamed("cid", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sets = named.groupBy("root", "cid").agg(F.sum(_blocks(F.col("m"), small)).alias("rows"), F.first("n").alias("n"))
    whole = sets.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), _large().alias("size"), F.sum("rows").alias("rows")).where(F.col("sets") * _blocks(F.col("size"), small) <= F.col("rows"))
    named = named.join(_few(materialise(whole.select("root", "size"), "joined")), "root", "left")
    node = F.when(F.col("size").isNull(), F.col("node")).otherwise(F.xxhash64("root"))
    return materialise(named.select("cid", "n", node.alias("node"), F.coalesce("size", "m").alias("m")).distinct(), "large")


def _split(large: DataFrame, classes: DataFrame, small: int) -> DataFrame:
    """(cid, node, blocks) that large buckets (cid, n, node, m) end in: split by further picks where that makes at most half the rows of comparing them in blocks."""
    done: list[DataFrame] = []
    blocks = F.when(F.col("m") <= small, 1).otherwise(_blocks(F.col("m"), small))
    for level in range(1, DEPTH + 1):
        deeper = classes.select("cid", F.explode(f"picks{level}").alias("pick"))
        tried = large.where(F.pmod(F.xxhash64("cid", F.lit(level)), F.ceil(F.col("m") / TRIAL)) == 0)
        shares = tried.groupBy("node").agg(F.count(F.lit(1)).alias("tried"), F.first("m").alias("m"))
        counts = tried.select("cid", "node").join(deeper, "cid").groupBy("node", "pick").agg(F.count(F.lit(1)).alias("c")).join(shares, "node")
        child = F.col("c") * F.col("m") / F.col("tried")
        rows = F.sum(child * F.when(child <= small, 1).otherwise(_blocks(child, small)))
        better = counts.groupBy("node").agg(rows.alias("rows"), F.first("m").alias("m")).where(F.col("rows") * 2 < F.col("m") * _blocks(F.col("m"), small))
        better = _few(materialise(better.select("node"), "splits"))
        if better.isEmpty():
            break
        done.append(large.join(better, "node", "left_anti").select("cid", "node", blocks.alias("blocks")))
        children = large.join(better, "node", "left_semi").join(deeper, "cid").select("cid", "n", F.xxhash64("node", "pick").alias("node"))
        sizes = children.groupBy("node").agg(F.count(F.lit(1)).alias("sets"), _large().alias("m")).where("sets > 1").drop("sets")
        children = materialise(children.join(sizes, "node"), "children")
        done.append(children.where(F.col("m") <= small).select("cid", "node", F.lit(1).alias("blocks")))
        large = children.where(F.col("m") > small)
    return reduce(DataFrame.unionAll, [*done, large.select("cid", "node", blocks.alias("blocks"))])


def buckets(classes: DataFrame, share: float, small: int = SMALL) -> DataFrame:
    """(unit, node, side, cid, n, members, count, picks, leaves): the rows of all buckets of ``classes`` (cid, n, members, picks of each level).

    ``picks`` are those picks that another set has too, of ``count`` in all; ``leaves`` are the
    buckets that the set ends in. Pairs have to share ``share`` of the picks of either, so if
    all sets leave out just fewer than that, of the picks that most sets have, such a pair still
    shares one of the others (prefix filter). A bucket that stays large is dealt out as blocks: each
    two of its blocks form a unit, whose pairs are those between different ``side`` s, or all where
    it is -1.
    """
    every = classes.select("cid", F.explode("picks0").alias("node"))
    counts = every.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    listed = every.join(counts, "node").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("m", "node"))).alias("ps"))
    held = listed.join(classes.select("cid", "n", "members", F.size("picks0").alias("count")), "cid").withColumn("picks", F.transform("ps", lambda p: p["node"]))
    left_out = F.ceil(F.col("count") * share).cast("int") - 1
    held = materialise(held.withColumn("indexed", F.slice("picks", 1, F.greatest(F.size("picks") - left_out, F.lit(0)))).drop("ps"), "picks")

    picked = held.select("cid", "n", F.explode("indexed").alias("node"))
    counts = picked.groupBy("node").agg(F.count(F.lit(1)).alias("sets"), _large().alias("m")).where("sets > 1").drop("sets")
    tagged = materialise(picked.join(counts, "node"), "nodes")
    every = tagged.where(F.col("m") <= small).select("cid", F.struct("node", F.lit(1).alias("blocks")).alias("b"))
    large = tagged.where(F.col("m") > small)
    if not large.isEmpty():
        every = every.unionAll(_split(_joined(large, small), classes, small).select("cid", F.struct("node", "blocks").alias("b")))
    ends = every.groupBy("cid").agg(F.collect_list("b").alias("bs"))
    known = ends.join(held.drop("indexed"), "cid").select("cid", "n", "members", "count", "picks", F.transform("bs", lambda b: b["node"]).alias("leaves"), F.explode("bs").alias("b"))
    block = F.pmod(F.xxhash64("cid"), F.col("b.blocks").cast("long")).cast("int")
    known = known.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)))
    x, y = F.least("block", "other"), F.greatest("block", "other")
    unit = F.when(F.col("b.blocks") == 1, F.col("b.node")).otherwise(F.xxhash64("b.node", x, y))
    side = F.when(x == y, -1).otherwise((F.col("block") == y).cast("int"))
    return known.select(unit.alias("unit"), F.col("b.node").alias("node"), side.alias("side"), "cid", "n", "members", "count", "picks", "leaves")


def promising(rows: DataFrame, threshold: float, share: float) -> DataFrame:
    """The rows of buckets that have a pair to be judged there, as a table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "unit").sortWithinPartitions("unit", "cid").mapInArrow(_promising(threshold, share), rows.schema)
    return materialise(dealt, "promising")


def verified(dealt: DataFrame, texts: DataFrame, threshold: float, share: float, size: int) -> DataFrame:
    """(cid, root, linked) of each bucket's rows that have links there, as a table; ``texts`` has a text for each cid."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = dealt.join(texts(dealt.select("cid").distinct()), "cid")
    found = read.repartition(parts, "unit").sortWithinPartitions("unit", "cid").mapInArrow(_verified(threshold, share, size), "cid long, root long, linked long")
    return materialise(found, "links")


def components(edges: DataFrame) -> DataFrame:
    """(cid, root): the smallest id of each connected component, as a table; only ids with an edge are listed."""
    with recorded() as made:
        both = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a")), "edges")
        roots = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "roots")
        while True:
            near = both.join(roots.select(F.col("u").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
            stepped = roots.join(near, "u").select("u", F.col("root").alias("old"), F.least("root", "near").alias("root"))
            jump = roots.select(F.col("u").alias("root"), F.col("root").alias("far"))
            stepped = materialise(stepped.join(jump, "root", "left").select("u", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "roots")
            roots = stepped.select("u", "root")
            discard_made(edges.sparkSession, made, both, stepped)
            if stepped.where("old <> root").isEmpty():
                discard_made(edges.sparkSession, made, stepped)
                return roots.select(F.col("u").alias("cid"), "root")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, small: int = SMALL) -> dict[str, DataFrame]:
    """The join's tables.

    ``rows``: (key, r1, r2, cid), a row for each row of ``df``, with its text's identity and its class;
    ``classes``: (cid, n, members), the classes of equal sets; ``links``: (cid, root, linked), a row for
    each bucket in which a class has links: a class it is connected with there, and with how many rows
    of other classes it is linked there; ``roots``: (cid, root) of every class. Tables that none of these
    reads are deleted as soon as what is made of them is written.
    """
    runs, share = runs_and_share(threshold, target_recall)
    r1, r2 = text_identity(text_or_empty(text))
    sketched = df.select(F.col(f"`{key}`").alias("key"), r1.alias("r1"), r2.alias("r2"), _sketcher(size, runs)(text_or_empty(text)).alias("s"))
    sketched = materialise(sketched.select("key", "r1", "r2", "s.*"), "sketches")
    levels = [f"picks{level}" for level in range(DEPTH + 1)]
    grouped = sketched.groupBy("n", "s1", "s2").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("r1", "r2", "key")).alias("text"), *[F.first(c).alias(c) for c in levels])
    classes = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def texts(wanted: DataFrame) -> DataFrame:
        """One row's text for each class, found by its key too: the other rows of a text that many have aren't shuffled to it."""
        ends = wanted.join(classes, "cid").select("cid", F.col("text.r1").alias("a"), F.col("text.r2").alias("b"), F.col("text.key").alias("k"))
        every = df.select(F.col(f"`{key}`").alias("key"), r1.alias("r1"), r2.alias("r2"), text_or_empty(text).alias("text"))
        same = (every["r1"] == ends["a"]) & (every["r2"] == ends["b"]) & every["key"].eqNullSafe(ends["k"])
        return every.join(ends, same).groupBy("cid").agg(F.first("text").alias("text"))

    with recorded() as made:
        rows_with_pairs = promising(buckets(classes.where("n > 0"), share, small), threshold, share)
        discard_made(df.sparkSession, made, rows_with_pairs)
        links = verified(rows_with_pairs, texts, threshold, share, size)
        discard_made(df.sparkSession, made, links)
    found = components(links.where("cid <> root").select(F.col("root").alias("a"), F.col("cid").alias("b")))
    roots = classes.select("cid").join(found, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"))
    rows = sketched.join(classes.select("n", "s1", "s2", "cid"), ["n", "s1", "s2"]).select("key", "r1", "r2", "cid")
    return {"rows": rows, "classes": classes.select("cid", "n", "members"), "links": links, "roots": roots}


def groups(tables: dict[str, DataFrame]) -> DataFrame:
    """(key, r1, r2, class_id, set_id, n_links): a row for each row.

    ``class_id`` is the smallest key of the group of linked texts, ``set_id`` that of the texts with
    the same set, ``n_links`` the number of other rows at the threshold or above, copies included.
    """
    links = tables["links"]
    linked = links.groupBy("cid").agg(F.sum("linked").alias("linked"))
    rows = materialise(tables["rows"], "rows")
    least = rows.groupBy("cid").agg(F.min("key").alias("set_id"), F.count(F.lit(1)).alias("members"))
    known = materialise(least.join(tables["roots"], "cid").join(linked, "cid", "left"), "known")
    first = known.groupBy("root").agg(F.min("set_id").alias("class_id"))
    known = known.join(first, "root").select("cid", "class_id", "set_id", (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).cast("long").alias("n_links"))
    return rows.join(known, "cid").select("key", "r1", "r2", "class_id", "set_id", "n_links")


def linked(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``groups`` of ``join``, with only the tables that it reads left."""
    with recorded() as made:
        found = groups(join(df, key, text, **options))
        discard_made(df.sparkSession, made, found)
    return found


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row of each group of linked texts: the one with the smallest key (of equal keys, the smallest text identity; of equal rows, one)."""
    with recorded() as made:
        found = linked(df, key, text, **options)
        stays = found.groupBy("class_id").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "r1", "r2")).alias("s"))
        stays = materialise(stays.select(F.col("s.key").alias("k"), F.col("s.r1").alias("a"), F.col("s.r2").alias("b")), "stays")
        discard_made(df.sparkSession, made, stays)
    r1, r2 = text_identity(text_or_empty(text))
    keyed = pack(df, key=F.col(f"`{key}`"), r1=r1, r2=r2)
    kept = keyed.join(stays, (keyed["r1"] == stays["a"]) & (keyed["r2"] == stays["b"]) & keyed["key"].eqNullSafe(stays["k"]), "left_semi")
    return unpack(kept.dropDuplicates(["key", "r1", "r2"]), df.columns)
