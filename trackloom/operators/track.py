"""Track combinators: map, filter, slice, zip, concatenate, reindex, and ordered running values.

Order is a column. Each operator says what it does to ``idx``; none relies on partition order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = ["track_id"]


def ordered(keys: list[str] | None = None, order: str | list[str] = "idx") -> Window:
    return Window.partitionBy(*(keys or TRACK)).orderBy(*([order] if isinstance(order, str) else order))


def so_far(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def reindexed(df: DataFrame, keys: list[str] | None = None, order: str | list[str] = "idx") -> DataFrame:
    """``idx`` from 0 without gaps."""
    return df.withColumn("idx", (F.row_number().over(ordered(keys, order)) - 1).cast("long"))


def transform(df: DataFrame, **columns: Column) -> DataFrame:
    """Lazy map: columns are replaced, order and count stay."""
    return df.withColumns(columns)


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that hold, with a new index."""
    return reindexed(df.where(condition))


def bounds(df: DataFrame, a: int, b: int) -> DataFrame:
    """Rows of the index range [min(a, b), b)."""
    return df.where((F.col("idx") >= min(a, b)) & (F.col("idx") < b))


def zipped(left: DataFrame, right: DataFrame, right_columns: dict[str, str]) -> DataFrame:
    """Rows with the same index; ``right_columns`` names what is taken from the right."""
    taken = right.select(*TRACK, "idx", *[F.col(c).alias(as_) for c, as_ in right_columns.items()])
    return left.join(taken, [*TRACK, "idx"])


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Files one after the other; ``file_ord`` keeps their order."""
    listed = [p.withColumn("file_ord", F.lit(i).cast("long")) for i, p in enumerate(parts)]
    return reindexed(reduce(lambda a, b: a.unionByName(b), listed), order=["file_ord", "idx"])


_RUNNING = {"sum": (F.sum, lambda here, before: F.coalesce(here + before, here, before)), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, value: Column, into: str, how: str = "sum", block: int | None = None, reverse: bool = False, inclusive: bool = True) -> DataFrame:
    """Running sum, min or max along ``idx`` (from the end with ``reverse``); null where nothing has come yet.

    With ``block``, a track longer than that is taken in blocks of index numbers: values of whole blocks
    first (pre-aggregated, few rows), then within each block, so no task sorts a whole long track. Every
    frame begins at the first row of its order, so a row costs the same wherever it stands.
    """
    total, joined = _RUNNING[how]
    last = Window.currentRow if inclusive else -1
    along = lambda c: F.col(c).desc() if reverse else F.col(c).asc()
    if block is None:
        return df.withColumn(into, total(value).over(Window.partitionBy(*TRACK).orderBy(along("idx")).rowsBetween(Window.unboundedPreceding, last)))
    cut = df.withColumn("__block", F.call_function("div", F.col("idx"), F.lit(block)))
    parts = cut.groupBy(*TRACK, "__block").agg(total(value).alias("__part"))
    before = Window.partitionBy(*TRACK).orderBy(along("__block")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*TRACK, "__block", total("__part").over(before).alias("__before"))
    inside = Window.partitionBy(*TRACK, "__block").orderBy(along("idx")).rowsBetween(Window.unboundedPreceding, last)
    return cut.join(parts, [*TRACK, "__block"]).withColumn(into, joined(total(value).over(inside), F.col("__before"))).drop("__block", "__before")


def with_gop(df: DataFrame, block: int | None = None) -> DataFrame:
    """``gop`` counts keyframes so far; rows before the first have 0."""
    return running(df, F.col("keyframe").cast("long"), "gop", block=block)


def shifted(df: DataFrame, offset: Column) -> DataFrame:
    """pts and dts moved; a result below zero is an error, overflow raises by itself."""
    def moved(c: str) -> Column:
        new = F.col(c) + offset
        return F.when(new >= 0, new).otherwise(F.raise_error(F.lit("InvalidArguments: shift below zero")).cast("long"))

    return df.withColumns({"pts": moved("pts"), "dts": moved("dts")})


def presentation_rank(df: DataFrame) -> DataFrame:
    """The rank of each sample by presentation time."""
    return df.withColumn("rank", (F.row_number().over(ordered(order=["pts", "idx"])) - 1).cast("long"))


def chunk_spans(df: DataFrame, block: int | None = None) -> DataFrame:
    """For each keyframe group: its index range, first pts, pts of its last sample, and pts of the next group's keyframe."""
    spans = with_gop(df, block).where("gop > 0").groupBy(*TRACK, "gop").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min_by("pts", "idx").alias("start_pts"), F.max_by("pts", "idx").alias("last_pts")
    )
    return spans.withColumn("next_pts", F.lead("start_pts").over(ordered(order="gop")))


def thumbnails(df: DataFrame, k: int) -> DataFrame:
    """At most ``k`` evenly spaced rows of each track, first and last included; one alone is the first."""
    sizes = df.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select(*TRACK, F.explode(F.sequence(F.lit(0), F.lit(max(k, 1) - 1))).alias("i"), "n")
    steps = max(k - 1, 1)
    place = F.call_function("div", F.col("i") * (F.col("n") - 1) * 2 + steps, F.lit(2 * steps))
    return df.join(wanted.select(*TRACK, F.when(F.lit(k > 1), place).otherwise(0).cast("long").alias("idx")).distinct(), [*TRACK, "idx"], "left_semi")
