"""Trim, stitch, interleave, overlap removal and timestamp repair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.arith import ms_to_ticks, ms_to_ticks_up, round_divide, seconds, whole_median
from trackloom.operators.editboxes import BOXES, as_array, trimmed, valid
from trackloom.operators.track import TRACK, ordered, running
from trackloom.sources.tables import materialise

LOOKBACK, ADJUSTMENTS = 16, 32


def durations(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, duration, error_category): all decode-time steps and their median for the last sample; decode times that fall make a track Invalid, without a duration."""
    keys = keys or TRACK
    stepped = samples.select(*keys, "dts", (F.col("dts") - F.lag("dts").over(ordered(keys))).alias("delta"))
    falls = F.coalesce(F.min("delta") < 0, F.lit(False))
    return stepped.groupBy(*keys).agg(F.when(~falls, F.max("dts") - F.min("dts") + whole_median("delta")).alias("duration"), F.when(falls, "Invalid").alias("error_category"))


def trim(samples: DataFrame, boxes: DataFrame | None, start_ms: int, duration_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, boxes, tracks) of a time range, re-based to the keyframe it needs.

    ``tracks`` has a row for each track: its output ``duration`` and ``error_category``. Invalid: boxes that
    are not valid; without boxes, decode times that fall or no duration at all; the first keyframe comes
    after the first sample of the range; a result of no duration. Unsupported: the keyframe is decoded after the
    range begins. Such tracks, and those without samples in the range, give no rows.

    What the range is, is found in a pass over the samples and written as a table of a row a track; samples meet it in one join,
    and what they amount to is seen over each track's kept rows.
    """
    if duration_ms <= 0:
        raise ValueError("InvalidArguments: a range without duration")
    start, length = ms_to_ticks(F.lit(start_ms).cast("long"), F.col("timescale")), ms_to_ticks_up(F.lit(duration_ms).cast("long"), F.col("timescale"))
    own = [c for c in ("idx", "pts", "dts", "timescale", "keyframe", "type") if c in samples.columns]
    rows = samples.select(*TRACK, *own)
    stepped = rows.withColumn("delta", F.col("dts") - F.lag("dts").over(ordered()))
    tracks = stepped.groupBy(*TRACK).agg(
        F.first("timescale").alias("timescale"), (F.max("dts") - F.min("dts") + whole_median("delta")).alias("whole"), F.coalesce(F.min("delta") < 0, F.lit(False)).alias("falls")
    )
    listed = tracks.join(as_array(boxes), TRACK, "left") if boxes is not None else tracks.withColumn("boxes", F.array().cast(BOXES))
    listed = listed.withColumn("boxes", F.coalesce("boxes", F.array().cast(BOXES)))
    plain = F.size("boxes") == 0
    wrong = F.when(~valid(F.col("boxes")) | (plain & (F.col("falls") | (F.col("whole") == 0))), "Invalid")
    cut = listed.select(*TRACK, wrong.alias("wrong"), trimmed(F.col("boxes"), start, F.when(plain, F.least(length, F.col("whole"))).otherwise(length)).alias("boxes"))
    real = F.filter("boxes", lambda b: b["start"] != -1)
    cut = cut.withColumns({"low": F.array_min(F.transform(real, lambda b: b["start"])), "high": F.array_max(F.transform(real, lambda b: b["start"] + b["duration"]))})

    inside = stepped.join(cut.where("wrong is null and low < high").select(*TRACK, "low", "high", "boxes"), TRACK)
    reached = inside.withColumn("first", F.min(F.when(F.col("pts") >= F.col("low"), F.col("idx"))).over(Window.partitionBy(*TRACK)))
    near = F.max(F.when(F.col("keyframe") & (F.col("pts") <= F.col("low")) & (F.col("idx") <= F.coalesce("first", "idx")), F.col("idx")))
    limits = reached.groupBy(*TRACK).agg(
        F.max("first").alias("first"),
        F.max(F.when(F.col("pts") < F.col("high"), F.col("idx"))).alias("last"),
        F.greatest(near, F.min(F.when(F.col("keyframe"), F.col("idx")))).alias("key"),
        F.min(F.when(F.col("keyframe"), F.col("idx"))).alias("first_key"),
    )
    late = F.coalesce(F.col("first_key") > F.col("first"), F.lit(False))
    found = F.coalesce(~late & (F.col("first") >= F.col("key")) & (F.col("last") >= F.col("first")), F.lit(False))
    limits = cut.join(limits.select(*TRACK, late.alias("late"), "key", "last", found.alias("found")), TRACK, "left")
    limits = materialise(limits, "limits")  # a row a track

    kept = stepped.join(limits.where("found").select(*TRACK, "key", "last", "low"), TRACK).where("idx between key and last")
    track = Window.partitionBy(*TRACK)
    step = F.when(F.col("idx") > F.col("key"), F.col("delta"))
    base = lambda over: over(F.min(F.when(F.col("idx") == F.col("key"), F.col("dts"))))
    length = lambda over: F.coalesce(over(F.sum(step)), F.lit(0)) + F.coalesce(F.floor(over(F.median(step))).cast("long"), F.lit(0).cast("long"))
    error = lambda over: F.when(base(over) > over(F.max("low")), "Unsupported").when(F.coalesce(over(F.min(step)) < 0, F.lit(False)) | (length(over) == 0), "Invalid")
    along, alone = lambda c: c.over(track), lambda c: c
    out = kept.withColumns({"base": base(along), "error": error(along)}).where("error is null")
    moved = {"idx": F.col("idx") - F.col("key"), "pts": F.col("pts") - F.col("base"), "dts": F.col("dts") - F.col("base")}
    result = out.select(*TRACK, *[moved.get(c, F.col(c)).alias(c) for c in own])
    facts = limits.join(kept.groupBy(*TRACK).agg(base(alone).alias("base"), length(alone).alias("duration"), error(alone).alias("error")), TRACK, "left")
    exploded = facts.where("base is not null and error is null").select(*TRACK, "base", F.posexplode("boxes").alias("ord", "b"))
    # A leading empty box is re-based like the others.
    new_boxes = exploded.select(*TRACK, "ord", (F.col("b.start") - F.col("base")).alias("start_pts"), F.col("b.duration").alias("duration_pts"))
    wrong = F.coalesce("wrong", F.when(F.col("late"), "Invalid"), "error")
    return result, new_boxes, facts.select(*TRACK, F.when(wrong.isNull(), F.coalesce("duration", F.lit(0).cast("long"))).alias("duration"), wrong.alias("error_category"))


def without_overlap(samples: DataFrame, block: int | None = None) -> DataFrame:
    """Rows that start before all later ones, where pts and dts go together: a suffix minimum."""
    later = running(samples, F.col("dts"), "__next", how="min", block=block, reverse=True, inclusive=False)
    return later.where("__next is null or dts < __next").drop("__next")


def folded(samples: DataFrame, inputs: list[str], start: Callable[[], Callable], finish: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema, order: Column) -> DataFrame:
    """Each track's rows in order through a step of its own, made by ``start``, which gets a row's ``inputs``; only the step's state outlives a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, step = None, None
        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in TRACK), strict=True)
            for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in inputs), strict=True), strict=True):
                if step is None or key != track:
                    track, step = key, start()
                out.append(step(*row))
            yield finish(batch, out)

    return samples.repartition(*TRACK).sortWithinPartitions(*TRACK, order).mapInArrow(run, schema)


def without_overlap_fold(samples: DataFrame) -> DataFrame:
    """Rows whose pts and dts are both below those of the last row kept, from the end: the general case, in order with one row as state."""

    def start() -> Callable:
        last = None

        def step(pts: int, dts: int) -> bool:
            nonlocal last
            keep = last is None or (pts < last[0] and dts < last[1])
            if keep:
                last = pts, dts
            return keep

        return step

    return folded(samples, ["pts", "dts"], start, lambda batch, keep: batch.filter(pa.array(keep, pa.bool_())), samples.schema, F.col("idx").desc_nulls_first())


def unique_times(samples: DataFrame) -> DataFrame:
    """pts and dts made unique against the sixteen largest values kept so far: both are bumped until neither is taken.

    Tracks without a repeat within the lookback leave as they are, in the JVM; only the others are
    folded in order.
    """
    w = ordered()
    before = w.rowsBetween(-LOOKBACK, -1)
    repeats = lambda c: F.array_contains(F.collect_list(c).over(before), F.col(c))
    falls = lambda c: F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False))
    hit, falls = repeats("pts") | repeats("dts"), falls("pts") | falls("dts")
    marked = samples.withColumn("__hit", hit | falls)
    tracks = marked.groupBy(*TRACK).agg(F.max("__hit").alias("dirty"))
    joined = samples.join(tracks, TRACK)

    def start() -> Callable:
        seen_pts: list[int] = []
        seen_dts: list[int] = []
        bumps = 0

        def step(pts: int, dts: int) -> tuple[int, int]:
            nonlocal bumps
            while pts in seen_pts or dts in seen_dts:
                bumps += 1
                if bumps > ADJUSTMENTS:
                    raise ValueError("Unsafe: too many repeated timestamps")
                pts, dts = pts + 1, dts + 1
            for seen in (seen_pts, seen_dts):
                if len(seen) >= LOOKBACK:
                    seen.remove(min(seen))
            seen_pts.append(pts)
            seen_dts.append(dts)
            return pts, dts

        return step

    def finish(batch: pa.RecordBatch, times: list) -> pa.RecordBatch:
        new = {"pts": pa.array([t[0] for t in times], pa.int64()), "dts": pa.array([t[1] for t in times], pa.int64())}
        return pa.RecordBatch.from_pydict({c: new.get(c, batch.column(c)) for c in batch.schema.names})

    clean = joined.where("not dirty").drop("dirty")
    dirty = joined.where("dirty").select(*samples.columns)
    return clean.unionByName(folded(dirty, ["pts", "dts"], start, finish, samples.schema, F.col("idx").asc_nulls_last()))


def interleaved(samples: DataFrame) -> DataFrame:
    """Audio and video in the order in which they are written: sound goes on while it is before the next picture, in single-precision seconds, and each kind keeps its own order.

    Where decode times fall, a row waits for those of its kind before it, so each row counts with the
    largest time of its kind so far; that makes the merge a sort. On ties video comes first.
    """
    rows = samples.where(F.col("type").isin("audio", "video"))
    own = Window.partitionBy(*TRACK, "type").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__time", F.max(seconds(F.col("dts"), F.col("timescale"))).over(own))
    order = Window.partitionBy(*TRACK).orderBy("__time", F.when(F.col("type") == "video", 0).otherwise(1), "idx")
    rows = rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).drop("__time")
    kind = Window.partitionBy(*TRACK, "type").orderBy("pos")
    return rows.withColumn("nth", (F.row_number().over(kind) - 1).cast("long"))


def rescaled(samples: DataFrame, timescale: Column) -> DataFrame:
    """Times in another timescale; sound can't be rescaled."""
    def to(c: str) -> Column:
        return F.when(F.col("type") == "audio", F.raise_error(F.lit("InvalidArguments: audio timescale is fixed")).cast("long")).otherwise(round_divide(F.col(c), timescale, F.col("timescale")))

    return samples.withColumns({"pts": to("pts"), "dts": to("dts"), "timescale": timescale})


def stitched(samples: DataFrame) -> DataFrame:
    """Files (``file_ord``) of one kind of track joined end to end: each is moved to begin where the durations before it end."""
    keys = [*TRACK, "file_ord"]
    each = durations(samples, keys).join(samples.groupBy(*keys).agg(F.min_by("dts", "idx").alias("first_dts")), keys)
    before = Window.partitionBy(*TRACK).orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*keys, (F.coalesce(F.sum("duration").over(before), F.lit(0)) - F.col("first_dts")).alias("offset"))
    moved = samples.join(each, keys)
    moved = moved.withColumns({"pts": F.col("pts") + F.col("offset"), "dts": F.col("dts") + F.col("offset")}).drop("offset")
    return moved.withColumn("idx", (F.row_number().over(ordered(order=["file_ord", "idx"])) - 1).cast("long"))


#: Bytes of a packed run of sound frames: twenty transport payloads of 184 bytes, less 19 of packet header.
ADTS_BYTES = 20 * (188 - 4) - (3 + 1 + 2 + 2 + 1 + 5 + 5)


def packed_adts(samples: DataFrame, sample_rate: int, limit: int = ADTS_BYTES, drift: int = 10) -> DataFrame:
    """``packet`` numbers of sound frames: a packet is full by size, or when its times can no longer be told from its first frame's."""
    schema = samples.withColumn("packet", F.lit(0).cast("long")).schema

    def start() -> Callable:
        packet, used, count, first = -1, 0, 0, None

        def step(pts: int, dts: int, size: int) -> int:
            nonlocal packet, used, count, first
            frame = size + 7
            if frame > limit:
                raise ValueError("Unsupported: audio bitrate is too high")
            guess = 90000 * count * 1024 // sample_rate
            if first is None or used + frame > limit or abs(first[0] + guess - pts) > drift or abs(first[1] + guess - dts) > drift:
                packet, used, count, first = packet + 1, 0, 0, (pts, dts)
            used, count = used + frame, count + 1
            return packet

        return step

    def finish(batch: pa.RecordBatch, packets: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(packets, pa.int64())], names=[*batch.schema.names, "packet"])

    return folded(samples, ["pts", "dts", "size"], start, finish, schema, F.col("idx").asc_nulls_last())
