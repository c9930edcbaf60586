"""What the command-line tools report or cut, as queries over tracks: frame listings, remuxing by keyframe groups, image frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.arith import round_divide, seconds
from trackloom.operators.containers import bitrate
from trackloom.operators.editboxes import with_real_pts
from trackloom.operators.track import TRACK, reindexed
from trackloom.operators.transforms import durations


def frame_listing(samples: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each sample with the second it is played at, in single precision; below zero where no box plays it."""
    rows = with_real_pts(samples, boxes)
    return rows.withColumn("play_time", seconds(F.col("real_pts"), F.col("timescale"))).drop("real_pts")


def track_listing(samples: DataFrame) -> DataFrame:
    """(track_id, type, n, duration, seconds, kbps) of each kind of track."""
    keys = [*TRACK, "type"]
    sums = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("timescale").alias("timescale")).join(durations(samples, keys), keys)
    length = F.col("duration").cast("double") / F.col("timescale")
    return sums.select(*keys, "n", "duration", length.alias("seconds"), bitrate(F.col("bytes"), F.col("duration"), F.col("timescale")).alias("kbps"))


def byte_order(samples: DataFrame) -> DataFrame:
    """Video and audio in the order of their bytes in the file, with a number for each kind and for all."""
    rows = samples.where(F.col("type").isin("video", "audio"))
    place = F.row_number().over(Window.partitionBy(*TRACK).orderBy("pos", "type", "idx")) - 1
    nth = F.row_number().over(Window.partitionBy(*TRACK, "type").orderBy("pos", "idx")) - 1
    return rows.withColumns({"place": place.cast("long"), "nth": nth.cast("long")})


def remuxed(samples: DataFrame, boxes: DataFrame, start_gop: int = 0, num_gops: int | None = None, kinds: tuple[str, ...] = ("video", "audio", "caption"), file_format: str = "regular") -> tuple[DataFrame, DataFrame]:
    """(samples, boxes) of ``num_gops`` keyframe groups from the ``start_gop``-th on.

    Video and captions are cut at keyframes' decode times, sound at the same times in its own ticks. A file without
    video is one group. Fewer groups than asked are taken as they are; a start beyond the last gives nothing.
    Edit boxes are kept only if all groups are, in a regular file: those of video, then those of sound.
    """
    keys = samples.where("type = 'video' and keyframe").select(*TRACK, "dts", F.col("timescale").alias("video_scale"), (F.row_number().over(Window.partitionBy(*TRACK).orderBy("idx")) - 1).alias("k"))
    ends = samples.groupBy(*TRACK).agg(F.max(F.when(F.col("type") == "audio", F.col("timescale"))).alias("audio_scale"), F.count_if(F.col("type") == "video").alias("n_video"))
    count = num_gops if num_gops is not None else 1 << 40
    limits = keys.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("gops"), F.max("video_scale").alias("video_scale"), F.max(F.when(F.col("k") == start_gop, F.col("dts"))).alias("low"), F.max(F.when(F.col("k") == start_gop + count, F.col("dts"))).alias("high")
    )
    limits = ends.join(limits, TRACK, "left").where("n_video = 0 or low is not null" if start_gop == 0 else "low is not null")
    rows = samples.where(F.col("type").isin(*kinds)).join(limits, TRACK)
    to = lambda c: F.when(F.col("type") == "audio", round_divide(F.col(c), F.col("audio_scale"), F.col("video_scale"))).otherwise(F.col(c))
    kept = rows.where((F.col("n_video") == 0) | ((F.col("dts") >= to("low")) & (F.col("high").isNull() | (F.col("dts") < to("high")))))
    out = reindexed(kept.select(*samples.columns), [*TRACK, "type"])
    whole = limits.where((F.lit(start_gop) == 0) & (F.col("high").isNull()) & F.lit(file_format == "regular"))
    kept_boxes = boxes.where(F.col("type").isin(*[k for k in kinds if k != "caption"])).join(whole.select(*TRACK), TRACK, "left_semi")
    order = (F.row_number().over(Window.partitionBy(*TRACK).orderBy(F.desc("type"), "ord")) - 1).cast("int")
    return out, kept_boxes.withColumn("ord", order)


def work_parts(samples: DataFrame, threads: int) -> DataFrame:
    """(track_id, part, first_dts, last_dts, n): whole keyframe groups of video, dealt out so that a part ends with the first group that begins after its share of the decode time."""
    video = samples.where("type = 'video'")
    final = Window.partitionBy(*TRACK)
    rows = video.withColumn("final", F.max("dts").over(final)).withColumn("share", round_divide(F.col("final"), 1, threads))
    keys = rows.where("keyframe and dts < final").select(*TRACK, "dts", "share")
    # A part begins at a keyframe more than a share after the part before began. A file that is decoded has fewer than MAX_SAMPLES rows, so its keyframes travel as one value.
    listed = keys.groupBy(*TRACK).agg(F.max("share").alias("share"), F.array_sort(F.collect_list("dts")).alias("ks"))
    zero = F.struct(F.lit(0).cast("long").alias("begin"), F.array(F.lit(0).cast("long")).alias("cuts"))
    step = lambda acc, k: F.when(k > acc["begin"] + F.col("share"), F.struct(k.alias("begin"), F.array_append(acc["cuts"], k).alias("cuts"))).otherwise(acc)
    cuts = listed.select(*TRACK, F.aggregate("ks", zero, step, lambda acc: acc["cuts"]).alias("cuts"))
    parted = rows.join(cuts, TRACK).withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("dts"))) - 1)
    return parted.groupBy(*TRACK, "part").agg(F.min("dts").alias("first_dts"), F.max("dts").alias("last_dts"), F.count(F.lit(1)).alias("n"))


def decode_start(samples: DataFrame, limit: int = 0x200) -> DataFrame:
    """``start``: the keyframe that decoding a row has to begin at; null if there is none among the ``limit`` rows up to it."""
    w = Window.partitionBy(*TRACK).orderBy("idx").rowsBetween(1 - limit, Window.currentRow)
    return samples.withColumn("start", F.max(F.when(F.col("keyframe"), F.col("idx"))).over(w))


def lingering(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Image frames with the last one repeated twice, a millisecond later each, where there are several."""
    last = Window.partitionBy(*keys)
    rows = frames.withColumn("__last", (F.col("idx") == F.max("idx").over(last)) & (F.count(F.lit(1)).over(last) > 1))
    again = rows.withColumn("__k", F.explode(F.when(F.col("__last"), F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    return again.withColumns({"idx": F.col("idx") + F.col("__k"), "pts": F.col("pts") + F.col("__k")}).drop("__last", "__k")


def parameter_changes(samples: DataFrame, value: Column) -> DataFrame:
    """(track_id, changes): how many parameter sets are kept when one is only added if it differs from the last."""
    rows = samples.where(value.isNotNull()).withColumn("__v", value)
    w = Window.partitionBy(*TRACK).orderBy("idx")
    return rows.withColumn("__new", ~F.col("__v").eqNullSafe(F.lag("__v").over(w))).groupBy(*TRACK).agg(F.count_if("__new").alias("changes"))
