"""Edit lists: validity, mapping of times into played time, trimming. Boxes are intervals (ord, start_pts, duration_pts); a start of -1 is an empty box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.arith import div, round_divide, single
from trackloom.operators.track import TRACK

BOXES = "array<struct<start:bigint,duration:bigint>>"


def box_array() -> Column:
    """The boxes of a group in order, as an aggregate. A list is at most a few dozen boxes, so it travels as one value."""
    listed = F.array_sort(F.collect_list(F.struct("ord", F.col("start_pts").alias("start"), F.col("duration_pts").alias("duration"))))
    return F.transform(listed, lambda b: F.struct(b["start"].alias("start"), b["duration"].alias("duration")))


def as_array(boxes: DataFrame) -> DataFrame:
    """(track_id, boxes): the boxes of each track in order."""
    return boxes.groupBy(*TRACK).agg(box_array().alias("boxes"))


def of_type(boxes: DataFrame, kind: str) -> DataFrame:
    """The boxes of one kind of track."""
    return boxes.where(F.col("type") == kind)


MAX_EDITS = 60


def loaded(edits: DataFrame, tracks: DataFrame) -> DataFrame:
    """Edit boxes of a file's edits (track_id, ord, start, duration in movie ticks; null stands for implicit).

    ``tracks``: (track_id, type, timescale, movie_timescale, duration, playback_duration in movie ticks).
    Durations are rescaled to track ticks; an implicit one is the whole track's (an implicit empty edit has no
    effect and goes); edits after those that cover the playback duration have none either and go.
    More than 60 edits are unsafe.
    """
    joined = edits.withColumnRenamed("duration", "edit").join(tracks, TRACK).where("start <> -1 or edit is not null")
    movie, own = F.col("movie_timescale"), F.col("timescale")
    length = F.coalesce("edit", round_divide(F.col("duration"), movie, own))
    per = Window.partitionBy(*TRACK)
    joined = joined.withColumn("edits", F.count(F.lit(1)).over(per)).withColumn("duration_pts", round_divide(length, own, movie))
    before = F.coalesce(F.sum("duration_pts").over(per.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = joined.withColumn("before", before).where(F.col("before") < round_divide(F.col("playback_duration"), own, movie))
    unsafe = F.when(F.col("edits") > MAX_EDITS, F.raise_error(F.lit("Unsafe: too many edits")).cast("long")).otherwise(F.col("start"))
    order = (F.row_number().over(per.orderBy("ord")) - 1).cast("int")
    return kept.select(*TRACK, order.alias("ord"), unsafe.alias("start_pts"), "duration_pts", F.lit(1.0).cast("float").alias("rate"), "type")


def written(boxes: DataFrame, tracks: DataFrame, file_format: str = "regular") -> DataFrame:
    """(track_id, ord, start_time, duration): edits in movie ticks (truncated) of boxes; only regular files take any, and captions can't."""
    if file_format != "regular":
        raise ValueError(f"Unsupported: edit boxes in a {file_format} file")
    joined = boxes.join(tracks.select(*TRACK, "type", "timescale", "movie_timescale"), [*TRACK, "type"])
    bad = F.when(F.col("type") == "caption", F.raise_error(F.lit("Unsupported: edit box in a caption track")).cast("long"))
    return joined.select(*TRACK, "type", "ord", F.coalesce(bad, F.col("start_pts")).alias("start_time"), div(F.col("duration_pts") * F.col("movie_timescale"), F.col("timescale")).alias("duration"))


def shifted(boxes: DataFrame, offset: Column) -> DataFrame:
    """Boxes moved by an offset; an empty box stays where it is and can only be moved by 0."""
    empty = F.col("start_pts") == -1
    moved = F.when(empty & (offset != 0), F.raise_error(F.lit("InvalidArguments: an empty box can't be moved")).cast("long")).when(empty, F.col("start_pts")).otherwise(F.col("start_pts") + offset)
    return boxes.withColumn("start_pts", moved)


def included(samples: DataFrame, boxes: DataFrame, start_ms: int, duration_ms: int) -> DataFrame:
    """Samples that are played in [start, start + duration) of milliseconds in single precision, and not before the first such one in file order, which anchors the output."""
    rows = with_real_pts(samples, boxes)
    time = (F.lit(1000.0).cast("float") * F.col("real_pts").cast("float") / single(F.col("timescale"))).cast("float")
    rows = rows.where((F.col("real_pts") >= 0) & (time >= F.lit(float(start_ms)).cast("float")) & (time < F.lit(float(start_ms + duration_ms)).cast("float")))
    first = rows.groupBy(*TRACK).agg(F.min_by("real_pts", "idx").alias("first_pts"))
    return rows.join(first, TRACK).where("real_pts >= first_pts").drop("first_pts")


def valid(boxes: Column) -> Column:
    """Non-empty boxes are ordered and don't overlap; an empty box is the first and not the only one."""
    state = F.struct(F.lit(True).alias("ok"), F.lit(0).cast("long").alias("end"), F.lit(True).alias("first"))

    def step(acc: Column, b: Column) -> Column:
        empty = b["start"] == -1
        ok = acc["ok"] & F.when(empty, acc["first"] & (F.size(boxes) > 1)).otherwise(b["start"] >= acc["end"])
        return F.struct(ok.alias("ok"), F.when(empty, acc["end"]).otherwise(b["start"] + b["duration"]).alias("end"), F.lit(False).alias("first"))

    return F.aggregate(boxes, state, step, lambda acc: acc["ok"])


def real_pts(boxes: Column, pts: Column) -> Column:
    """The played time of ``pts``, or -1 where no box plays it.

    A time that equals the end of an earlier box doesn't reach a later one. No boxes: unchanged.
    """
    state = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("found"), F.lit(False).alias("stopped"))

    def step(acc: Column, b: Column) -> Column:
        empty, inside = b["start"] == -1, (pts >= b["start"]) & (pts < b["start"] + b["duration"])
        passed = empty | (pts > b["start"] + b["duration"])
        return F.when(acc["stopped"], acc).otherwise(
            F.struct(
                F.when(passed, acc["before"] + b["duration"]).otherwise(acc["before"]).alias("before"),
                F.when(~empty & inside, acc["before"] + pts - b["start"]).alias("found"),
                (~passed).alias("stopped"),
            )
        )

    return F.when(F.size(boxes) == 0, pts).otherwise(F.coalesce(F.aggregate(boxes, state, step, lambda acc: acc["found"]), F.lit(-1).cast("long")))


def with_real_pts(samples: DataFrame, boxes: DataFrame) -> DataFrame:
    """``samples`` with ``real_pts``: an equi-join on the track, then one pass over its few boxes."""
    listed = samples.join(as_array(boxes), TRACK, "left")
    return listed.withColumn("real_pts", real_pts(F.coalesce("boxes", F.array().cast(BOXES)), F.col("pts"))).drop("boxes")


def played(samples: DataFrame, boxes: DataFrame) -> DataFrame:
    """Samples that some box plays."""
    return with_real_pts(samples, boxes).where("real_pts >= 0").drop("real_pts")


def trimmed(boxes: Column, start: Column, duration: Column) -> Column:
    """The boxes that play [start, start + duration) of the played time of ``boxes``.

    A leading empty box is played time too: what is left of it stays a leading empty box, and a
    range that lies in it gives no boxes.
    """
    leading = F.when((F.size(boxes) > 0) & (F.get(boxes, F.lit(0))["start"] == -1), F.get(boxes, F.lit(0))["duration"]).otherwise(F.lit(0).cast("long"))
    rest = F.filter(boxes, lambda b: b["start"] != -1)
    s = F.greatest(start - leading, F.lit(0).cast("long"))
    left = F.greatest(leading - start, F.lit(0).cast("long"))
    d = duration - left
    ends = F.transform(rest, lambda b, i: F.struct(b["start"].alias("start"), b["duration"].alias("duration"), F.aggregate(F.slice(rest, 1, i), F.lit(0).cast("long"), lambda a, x: a + x["duration"]).alias("before")))
    cut = F.transform(
        ends,
        lambda b: F.struct(
            (b["start"] + F.greatest(s - b["before"], F.lit(0).cast("long"))).alias("start"),
            (F.least(s + d, b["before"] + b["duration"]) - F.greatest(s, b["before"])).alias("duration"),
        ),
    )
    whole = F.array(F.struct(s.alias("start"), d.alias("duration")))
    out = F.when(F.size(rest) == 0, whole).otherwise(F.filter(cut, lambda b: b["duration"] > 0))
    empty = F.when(left > 0, F.array(F.struct(F.lit(-1).cast("long").alias("start"), left.alias("duration")))).otherwise(F.array().cast(BOXES))
    return F.when(d > 0, F.concat(empty, out.cast(BOXES))).otherwise(F.array().cast(BOXES))


def frame_interval(samples: DataFrame, boxes: DataFrame) -> DataFrame:
    """For each box: the first index at or after its start and the last before its end."""
    joined = samples.select(*TRACK, "idx", "pts").join(boxes.where("start_pts >= 0"), TRACK)
    end = F.col("start_pts") + F.col("duration_pts")
    return joined.groupBy(*TRACK, "ord").agg(F.min(F.when(F.col("pts") >= F.col("start_pts"), F.col("idx"))).alias("first_idx"), F.max(F.when(F.col("pts") < end, F.col("idx"))).alias("last_idx"))


def total(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy(*TRACK).agg(F.sum("duration_pts").alias("duration"))


def play_offsets(boxes: DataFrame) -> DataFrame:
    """Played time before each box."""
    before = Window.partitionBy(*TRACK).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return boxes.withColumn("offset", F.coalesce(F.sum("duration_pts").over(before), F.lit(0)))
