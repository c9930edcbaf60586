"""Pictures that were encoded anew, in the times at which the pictures they were made from are played, with the sound that belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.arith import ceil_divide, div, seconds
from trackloom.operators.track import TRACK


def played_times(played: DataFrame) -> DataFrame:
    """(track_id, rank, real_pts, first): the played times (``real_pts``, from 0) of each track in their order, and the first of them."""
    rows = played.where("real_pts >= 0")
    order = Window.partitionBy(*TRACK).orderBy("real_pts", "idx")
    return rows.select(*TRACK, (F.row_number().over(order) - 1).cast("long").alias("rank"), "real_pts", F.first("real_pts").over(order).alias("first"))


def retimed(encoded: DataFrame, played: DataFrame, factor: int) -> tuple[DataFrame, DataFrame]:
    """(pictures, tracks): every ``factor``-th played time is that of the next encoded picture, from 0 on.

    A strided rank join: the k-th picture meets the played time of rank k * ``factor``. ``tracks`` has each track's number of ``frames``,
    ``first`` played time and ``error_category``: Invalid, without pictures or if there aren't as many as times of that stride.
    """
    if factor <= 0:
        raise ValueError("InvalidArguments: a stride below one")
    times = played_times(played)
    counts = times.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("times"), F.min("real_pts").alias("first"))
    frames = encoded.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("frames"))
    tracks = frames.join(counts, TRACK, "full")
    wrong = F.col("frames").isNull() | F.col("times").isNull() | (F.col("frames") != ceil_divide(F.col("times"), F.lit(1), F.lit(factor)))
    tracks = tracks.select(*TRACK, F.coalesce("frames", F.lit(0).cast("long")).alias("frames"), "first", F.when(wrong, "Invalid").alias("error_category"))
    strided = times.where(F.col("rank") % factor == 0).select(*TRACK, div(F.col("rank"), factor).alias("idx"), (F.col("real_pts") - F.col("first")).alias("pts"))
    good = tracks.where("error_category is null").select(*TRACK)
    pictures = encoded.drop("pts", "dts").join(strided, [*TRACK, "idx"]).join(good, TRACK, "left_semi").withColumn("dts", F.col("pts"))
    return pictures, tracks


def sound_within(sound: DataFrame, pictures: DataFrame, tracks: DataFrame) -> DataFrame:
    """The sound that is decoded before the last picture and not before the first played time, from 0 on, with ``audio_first``: the decode time it began at.

    Sound waits for a picture decoded after it, in single-precision seconds, and holds up what comes after it: a row counts with the
    latest decode time of its track so far.
    """
    last = pictures.groupBy(*TRACK).agg(F.max_by(seconds(F.col("dts"), F.col("timescale")), "idx").alias("__last"), F.max("timescale").alias("__scale"))
    rows = sound.join(last.join(tracks.select(*TRACK, "first"), TRACK), TRACK)
    own = Window.partitionBy(*TRACK).orderBy("idx")
    waits = F.max(seconds(F.col("dts"), F.col("timescale"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offset = div(F.col("first") * F.col("timescale"), F.col("__scale"))
    kept = rows.withColumns({"__waits": waits, "__offset": offset}).where("__waits < __last and dts >= __offset")
    kept = kept.withColumn("audio_first", F.first("dts").over(own))
    moved = {c: F.col(c) - F.col("audio_first") for c in ("pts", "dts")} | {"idx": (F.row_number().over(own) - 1).cast("long")}
    return kept.withColumns(moved).drop("__last", "__scale", "__waits", "__offset", "first")


def boxes_within(boxes: DataFrame, firsts: DataFrame) -> DataFrame:
    """Sound's edit boxes moved with it: ``firsts`` has each track's ``audio_first`` and ``offset``, the first played time in sound's ticks, by which the first box begins later and is shorter."""
    first = F.col("ord") == F.min("ord").over(Window.partitionBy(*TRACK))
    rows = boxes.join(firsts, TRACK).withColumn("__cut", F.when(first, F.col("offset")).otherwise(0))
    moved = {"start_pts": F.col("start_pts") + F.col("__cut") - F.col("audio_first"), "duration_pts": F.col("duration_pts") - F.col("__cut")}
    return rows.withColumns(moved).drop("__cut", "offset", "audio_first")
