"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

Components become whole numbers (``floor(scale * x)``), so scores are exact inner products. With one more
component, ``sqrt(M**2 - |x|**2)`` for the largest norm M of the table (0 for a vector that is searched for),
the distance of a row from an anchor is ``sqrt(|q|**2 + M**2 - 2 * score)``: nearer means a higher score, and a
window of scores is an annulus of distances.

Rows with equal vectors and labels are one class with their smallest few ids, which is all a search can
return of them, so a vector that a third of the rows have is one row. A tree over a sample of at most
``SAMPLE`` classes (``SAMPLE`` bounds what the driver and a broadcast hold) cuts space into cells; every class
of the table goes to its cell, and a cell of more than ``CELL`` classes is dealt out to several buckets. Each
bucket is indexed by a tree of its own. An anchor visits the buckets of the cells that can hold one of its
results: those that meet the annulus and aren't farther than what the sample alone offers. In a bucket the tree
is walked nearest first: a heap of nodes by their least possible distance, only inside the annulus, until the k
best rows found with the right kind of label are nearer than all that is left. Distances only prune, with a
margin for rounding; scores decide. So the search is exact, and its recall 1.

Anchors are read against buckets in units of a bucket and ``QUERIES`` anchors: a task holds one bucket's
classes and streams its anchors. Both searches, for positives and then for negatives within the windows the
positives give, keep k rows for an anchor and bucket at most, and a window merges them. What meets in one key is
bounded by k and the number of buckets.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part;
shorter vectors are filled up with zeros (an empty one is all zeros); repeated rows are rows of their own, so a
repeated anchor is returned as often, and only the row itself isn't its own positive; an anchor without a
positive, or a positive without a negative in its window, has no rows; components so large that a score could
pass 2**53 are an error; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm.common import discard_made, materialise, recorded

SAMPLE = 4096
CELL = 16_384
#: A cell has at least so many classes, and at least so many sampled ones.
LEAST_CELL, LEAST_SAMPLED = 2048, 16
QUERIES = 65_536
LEAF = 512
#: Relative margin of distances for rounding.
MARGIN = 1e-9


# ---------------------------------------------------------------- trees

class Tree:
    """A vantage-point tree over rows (whole numbers) and their extra component, by nested nodes of row numbers.

    ``nodes``: (vantage, radius, inner, outer) or (None, rows): rows of the inner child are at most ``radius``
    away from the row ``vantage``, those of the outer child farther.
    """

    def __init__(self, rows: np.ndarray, extra: np.ndarray, leaf: int):
        self.rows, self.extra, self.nodes = rows, extra, []
        self.grow(np.arange(len(rows)), leaf)

    def distances(self, vantage: int, rows: np.ndarray, extra: np.ndarray) -> np.ndarray:
        away = rows - self.rows[vantage]
        return np.sqrt(np.einsum("ij,ij->i", away, away) + (extra - self.extra[vantage]) ** 2)

    def grow(self, members: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((None, members))
        if len(members) > leaf:
            centre = self.rows[members].mean(0)
            vantage = int(members[np.argmax(((self.rows[members] - centre) ** 2).sum(1))])
            far = self.distances(vantage, self.rows[members], self.extra[members])
            radius = float(np.partition(far, len(far) // 2)[len(far) // 2])
            inside = far <= radius
            if inside.all():
                inside = far < radius
                radius = float(far[inside].max()) if inside.any() else radius
            if inside.any() and not inside.all():
                inner = self.grow(members[inside], leaf)
                self.nodes[at] = (vantage, radius, inner, self.grow(members[~inside], leaf))
        return at

    def vantages(self, queries: np.ndarray) -> np.ndarray:
        """Distances of queries (extra component 0) from each node's vantage; leaves have 0."""
        at = [i for i, n in enumerate(self.nodes) if n[0] is not None]
        out = np.zeros((len(queries), len(self.nodes)))
        if at:
            v = [self.nodes[i][0] for i in at]
            square = (self.rows[v] ** 2).sum(1) + self.extra[v] ** 2
            out[:, at] = np.sqrt(np.maximum((queries**2).sum(1)[:, None] + square - 2 * (queries @ self.rows[v].T), 0))
        return out

    def routed(self, rows: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """The leaf node that each row belongs to."""
        found, waiting = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while waiting:
            at, members = waiting.pop()
            node = self.nodes[at]
            if node[0] is None:
                found[members] = at
            elif len(members):
                inside = self.distances(node[0], rows[members], extra[members]) <= node[1]
                waiting += [(node[2], members[inside]), (node[3], members[~inside])]
        return found

    def leaves(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n[0] is None]

    def reach(self, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distance of each node's rows, for queries with these distances from the vantages."""
        least, most = np.zeros_like(far), np.full_like(far, np.inf)
        for at, node in enumerate(self.nodes):  # a parent stands before its children
            if node[0] is not None:
                _, radius, inner, outer = node
                least[:, inner] = np.maximum(least[:, at], far[:, at] - radius)
                most[:, inner] = np.minimum(most[:, at], far[:, at] + radius)
                least[:, outer] = np.maximum(least[:, at], radius - far[:, at])
                most[:, outer] = most[:, at]
        return least, most


class Best:
    """The k first (score, id, class) of those offered: higher scores, then smaller ids."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor, self.found = k, floor, []

    def offer(self, scores: np.ndarray, at: np.ndarray, ids: list) -> None:
        self.found += [(-int(s), i, int(c)) for s, c in zip(scores, at, strict=True) for i in ids[c]]
        self.found = sorted(self.found)[: self.k]
        if len(self.found) == self.k:
            self.floor = max(self.floor, -self.found[-1][0])


def walk(tree: Tree, query: np.ndarray, far: np.ndarray, square: float, low: float, high: float, fits: np.ndarray, ids: list, best: Best, seen: dict) -> list[tuple]:
    """The first rows of a score between ``low`` and ``high`` that ``fits`` marks. ``seen`` keeps scores of leaves for an anchor's next window."""
    def distance(score: float) -> float:
        return np.sqrt(max(square - 2 * score, 0.0))

    inner, outer = distance(high) * (1 - MARGIN), distance(low) * (1 + MARGIN)
    heap = [(inner, 0, 0.0, np.inf)]
    while heap:
        bound, at, least, most = heapq.heappop(heap)
        if bound > distance(max(best.floor, low)) * (1 + MARGIN):
            break
        node = tree.nodes[at]
        if node[0] is None:
            scores = seen.get(at)
            if scores is None:
                scores = seen[at] = tree.rows[node[1]] @ query
            hit = np.flatnonzero((scores >= max(low, best.floor)) & (scores <= high) & fits[node[1]])
            if len(hit):
                if len(hit) > best.k:  # ties stay
                    hit = hit[scores[hit] >= np.partition(scores[hit], -best.k)[-best.k]]
                best.offer(scores[hit], node[1][hit], ids)
            continue
        _, radius, near, away = node
        d = far[at]
        for child, a, b in ((near, max(least, d - radius), min(most, d + radius)), (away, max(least, radius - d), most)):
            if a <= outer and b * (1 + MARGIN) >= inner:
                heapq.heappush(heap, (max(a * (1 - MARGIN), inner), child, a, b))
    return best.found


# ---------------------------------------------------------------- Spark

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _extra(rows: np.ndarray, largest: float) -> np.ndarray:
    return np.sqrt(np.maximum(largest - (rows**2).sum(1), 0))


class Index:
    """What all tasks know: the tree over the sample, its rows with label codes, and the buckets of each cell."""

    def __init__(self, rows: np.ndarray, labels: list, largest: float, leaf: int):
        self.largest, self.width = largest, rows.shape[1]
        self.tree = Tree(rows, _extra(rows, largest), leaf)
        self.labels = np.array(labels)
        self.cells = self.tree.leaves()
        self.buckets = {c: (i, 1) for i, c in enumerate(self.cells)}  # first bucket and how many

    def deal(self, counts: dict[int, int], cell: int) -> int:
        """Number the buckets of all cells; how many there are."""
        n = 0
        for c in self.cells:
            parts = max(1, -(-counts.get(c, 0) // cell))
            self.buckets[c] = n, parts
            n += parts
        return n


_FOUND = pa.schema([("qid", pa.int64()), ("window", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("cid", pa.int64())])


def _searched(sent, k: int, same: bool):
    """Walk each unit's tree for its anchors; ``same``: rows of the anchor's label, else of the others."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, unit, held, tree = sent.value, None, [], None
        for batch in batches:
            units, is_query = batch.column("unit").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(units) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(units)], strict=True):
                part = batch.slice(a, b - a)
                if units[a] != unit:
                    unit, held, tree = units[a], [], None
                if not is_query[a]:
                    held.append(part)
                    continue
                if not held:
                    continue  # a bucket without rows
                if tree is None:
                    table = pa.Table.from_batches(held)
                    rows = _matrix(table.column("vec"), index.width)
                    tree = Tree(rows, _extra(rows, index.largest), LEAF)
                    codes, cids, ids = table.column("label").to_numpy(), table.column("cid").to_numpy(), table.column("ids").to_pylist()
                queries = _matrix(part.column("vec"), index.width)
                far, square = tree.vantages(queries), (queries**2).sum(1) + index.largest
                out: list[tuple] = []
                for q, (qid, label, windows) in enumerate(zip(part.column("cid").to_pylist(), part.column("label").to_pylist(), part.column("windows").to_pylist(), strict=True)):
                    fits, seen = (codes == label) == same, {}
                    for w in windows:
                        found = walk(tree, queries[q], far[q], square[q], w["low"], w["high"], fits, ids, Best(k, w["floor"]), seen)
                        out += [(qid, w["window"], -s, i, int(cids[c])) for s, i, c in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_FOUND)

    return work


def _search(classes: DataFrame, queries: DataFrame, sent, k: int, same: bool, units: int) -> DataFrame:
    """(qid, window, score, id, cid): the first k rows of ``classes`` (cid, vec, label, ids, bucket) for each window of ``queries`` (cid, vec, label, windows)."""

    @F.arrow_udf("struct<windows:array<struct<window:bigint,low:bigint,high:bigint,floor:double>>,buckets:array<int>>")
    def route(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """The buckets that can hold a result, and the k-th best score of the sample as a first floor."""
        index = sent.value
        cells = np.array(index.cells)
        for vecs, labels, windows in batches:
            rows, out = _matrix(vecs, index.width), []
            least, most = index.tree.reach(index.tree.vantages(rows))
            square, sampled = (rows**2).sum(1) + index.largest, rows @ index.tree.rows.T
            for q, (label, listed) in enumerate(zip(labels.to_pylist(), windows.to_pylist(), strict=True)):
                right = sampled[q][(index.labels == label) == same]
                kept, wanted = [], np.zeros(len(cells), bool)
                for w in listed:
                    inside = right[(right >= w["low"]) & (right <= w["high"])]
                    floor = float(np.partition(inside, -k)[-k]) if len(inside) >= k else float(w["low"])
                    inner = np.sqrt(max(square[q] - 2 * w["high"], 0)) * (1 - MARGIN)
                    outer = np.sqrt(max(square[q] - 2 * floor, 0)) * (1 + MARGIN)
                    wanted |= (least[q, cells] <= outer) & (most[q, cells] * (1 + MARGIN) >= inner)
                    kept.append(w | {"floor": floor})
                buckets = [n for c in cells[wanted].tolist() for n in range(index.buckets[c][0], sum(index.buckets[c]))]
                out.append({"windows": kept, "buckets": buckets})
            yield pa.array(out, pa.struct([("windows", pa.list_(pa.struct([("window", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("floor", pa.float64())]))), ("buckets", pa.list_(pa.int32()))]))

    parts = max(1, -(-queries.count() // QUERIES))
    block = F.pmod(F.xxhash64("cid"), F.lit(parts))
    routed = queries.withColumn("to", route("vec", "label", "windows"))
    asked = routed.select(F.explode(F.transform("to.buckets", lambda b: b.cast("long") * parts + block)).alias("unit"), F.lit(True).alias("query"), "cid", "vec", "label", F.lit(None).cast("array<bigint>").alias("ids"), F.col("to.windows").alias("windows"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    given = classes.withColumn("block", every).select((F.col("bucket").cast("long") * parts + F.col("block")).alias("unit"), F.lit(False).alias("query"), "cid", "vec", "label", "ids", F.lit(None).cast(asked.schema["windows"].dataType).alias("windows"))
    dealt = asked.unionAll(given).repartition(max(1, min(units * parts, 20_000)), "unit").sortWithinPartitions("unit", "query")
    found = dealt.mapInArrow(_searched(sent, k, same), "qid long, window long, score long, id long, cid long")
    first = Window.partitionBy("qid", "window").orderBy(F.desc("score"), "id", "cid")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def usable(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, vec): rows that take part, with whole components."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("v", lambda x: F.floor(x * scale))
    return rows.where("id is not null and label is not null and v is not null").where(sound).select("id", "label", whole.alias("vec"))


def mine(df: DataFrame, anchor: Column, **options) -> DataFrame:
    """``mined`` with only the tables that it reads left."""
    with recorded() as made:
        found = mined(df, anchor, **options)
        discard_made(df.sparkSession, made, found)
    return found


def mined(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, cell: int = CELL
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` (of the column ``id``) holds.

    A positive is one of the anchor's first ``n_positives`` other rows of its label; its negatives are the
    first ``n_negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of its own.
    """
    spark = df.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(df, key, vector, label, scale)
    facts = rows.agg(F.max(F.size("vec")).alias("width"), F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).first()
    if facts["width"] is None:
        return spark.createDataFrame([], result)
    width, most = max(facts["width"], 1), facts["most"] or 0
    if most**2 * width >= 2**53:
        raise ValueError(f"components up to {most} in {width} dimensions: scores could pass 2**53")
    vec = F.concat(F.col("vec").cast("array<int>"), F.array_repeat(F.lit(0), F.lit(width) - F.size("vec")))
    rows = rows.select("id", "label", vec.alias("vec"))

    kept = max(n_positives + 1, n_negatives)
    alike = Window.partitionBy("vec", "label").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= kept)
    classes = few.groupBy("vec", "label").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    square = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "vec", F.col("label").alias("name"), F.xxhash64("label").alias("label"), "ids", square.alias("square")), "classes")
    total, largest = classes.agg(F.count(F.lit(1)), F.max("square")).first()

    cell = min(cell, max(LEAST_CELL, -(-total // (4 * spark.sparkContext.defaultParallelism))))
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("vec", "label").collect()
    index = Index(np.array([r["vec"] for r in sample], np.float64), [r["label"] for r in sample], float(largest), max(LEAST_SAMPLED, len(sample) * cell // total))
    tree = index.tree

    @F.arrow_udf("int")
    def cell_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vecs in batches:
            held = _matrix(vecs, width)
            yield pa.array(routing.value.routed(held, _extra(held, float(largest))).astype(np.int32))

    routing = spark.sparkContext.broadcast(tree)
    placed = materialise(classes.withColumn("cell", cell_of("vec")), "placed")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    n_buckets = index.deal(counts, cell)
    sent = spark.sparkContext.broadcast(index)
    starts = F.array(*[F.lit(index.buckets.get(c, (0, 1))[0]) for c in range(len(tree.nodes))])
    shares = F.array(*[F.lit(index.buckets.get(c, (0, 1))[1]) for c in range(len(tree.nodes))])
    dealt = placed.select("cid", "vec", "label", "ids", (F.get(starts, "cell") + F.pmod(F.xxhash64("cid"), F.get(shares, "cell").cast("long"))).alias("bucket"))

    anchors = rows.where(anchor).select(F.col("id").alias("anchor_id"), "vec", F.col("label").alias("name"))
    anchors = materialise(anchors.join(classes.select("cid", "vec", "name"), ["vec", "name"]).select("anchor_id", "cid"), "anchors")
    asked = classes.join(anchors.select("cid").distinct(), "cid", "left_semi").select("cid", "vec", "label")
    reach = int(largest) + 1
    window = lambda w, a, b: F.struct(w.cast("long").alias("window"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    everything = F.array(window(F.lit(0), F.lit(-reach), F.lit(reach)))
    positives = _search(dealt, asked.withColumn("windows", everything), sent, n_positives + 1, True, n_buckets)
    one = F.struct("place", F.col("score").alias("score"), F.col("id").alias("id"), F.col("cid").alias("of"))
    positives = materialise(positives.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("positives")), "positives")

    def bounds(p: Column) -> Column:
        return window(p, F.ceil(p * low / F.lit(100).cast("double")), F.floor(p * high / F.lit(100).cast("double")))

    scores = F.transform(F.array_distinct(F.transform("positives", lambda p: p["score"])), bounds)
    windows = positives.select(F.col("qid").alias("cid"), F.filter(scores, lambda w: w["low"] <= w["high"]).alias("windows")).where(F.size("windows") > 0)
    negatives = _search(dealt, asked.join(windows, "cid"), sent, n_negatives, False, n_buckets)
    found = negatives.groupBy("qid", "window").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("n"))
    found = found.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("window", "n"))).alias("negatives"))
    known = materialise(positives.join(found, "qid").withColumnRenamed("qid", "cid"), "negatives")

    whole = anchors.join(known, "cid")
    own = F.filter("positives", lambda p: (p["id"] == F.col("anchor_id")) & (p["of"] == F.col("cid")))
    others = F.slice(F.filter("positives", lambda p: F.coalesce(p["place"] != F.get(own, 0)["place"], F.lit(True))), 1, n_positives)
    pairs = whole.select("anchor_id", F.explode(others).alias("p"), "negatives")
    triples = pairs.select("anchor_id", "p", F.explode(F.try_element_at("negatives", F.col("p.score"))).alias("n"))
    return triples.select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("n.place").cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score")
    )
