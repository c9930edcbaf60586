"""Comparing tracks: as-of captions, quality by time bucket, positional difference, validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.arith import psnr, single
from trackloom.operators.editboxes import box_array, valid
from trackloom.operators.track import TRACK, ordered, with_gop

MAX_GOP, MAX_SAMPLES = 0x200, 0x4000


def captions_ahead(video: DataFrame, captions: DataFrame) -> DataFrame:
    """For each video sample the first caption at or after its pts, whether or not it is near.

    One union and one window, no range join: the next caption's time and index are carried back over the samples before it.
    """
    both = video.select(*TRACK, "idx", "pts", F.lit(None).cast("struct<at:bigint,idx:bigint>").alias("c")).unionByName(
        captions.select(*TRACK, F.lit(None).cast("long").alias("idx"), "pts", F.struct(F.col("pts").alias("at"), F.col("idx").alias("idx")).alias("c"))
    )
    # From the last time to the first, so that the frame begins at its first row and grows by one: a row costs the same wherever it stands.
    ahead = Window.partitionBy(*TRACK).orderBy(F.desc("pts"), F.col("c").isNotNull().desc(), F.col("c.idx").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("next", F.last("c", ignorenulls=True).over(ahead)).where("idx is not null")
    return found.select(*TRACK, "idx", "pts", F.col("next.idx").alias("caption_idx"), F.col("next.at").alias("caption_pts"))


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def plane_quality(reference: DataFrame, test: DataFrame, on: list[str], plane: str = "plane") -> DataFrame:
    """(keys, sse, pixels, psnr) of planes with the same keys; equal planes count neither error nor pixels."""
    pairs = reference.select(*on, F.col(plane).alias("a")).join(test.select(*on, F.col(plane).alias("b")), on)
    same = F.col("a").eqNullSafe(F.col("b"))
    scored = pairs.select(*on, F.when(same, F.lit(0).cast("long")).otherwise(squared_error(F.col("a"), F.col("b"))).alias("sse"), F.when(same, 0).otherwise(F.size("a")).cast("long").alias("pixels"))
    return scored.withColumn("psnr", psnr(F.col("sse") / F.nullif(F.col("pixels"), F.lit(0).cast("long"))))


def overall_quality(frames: DataFrame) -> DataFrame:
    """PSNR of all error over all pixels."""
    return frames.agg(F.sum("sse").alias("sse"), F.sum("pixels").alias("pixels")).withColumn("psnr", psnr(F.col("sse") / F.nullif(F.col("pixels"), F.lit(0).cast("long"))))


def bucket(pts: Column, timescale: Column) -> Column:
    """Hundredths of a second of a played time, in single precision and truncated."""
    hundredths = pts.cast("float") * F.lit(100.0).cast("float")
    return (hundredths / single(timescale)).cast("float").cast("long")


def bucket_quality(reference: DataFrame, test: DataFrame, plane: str = "plane") -> DataFrame:
    """(track, n_reference, n_test, matched, sse, pixels, psnr, error_category) of played frames that share a time bucket.

    ``real_pts`` (below zero where no box plays a frame) and ``timescale`` give the bucket. Two test frames
    in a bucket make the track Invalid; several reference frames may share one test frame; frames
    without a partner are counted only. Frames meet in their (track, bucket): nothing is compared across.
    """
    def shown(df: DataFrame, test_: bool) -> DataFrame:
        return df.where("real_pts >= 0").select(*TRACK, bucket(F.col("real_pts"), F.col("timescale")).alias("time"), F.col(plane).alias("a"), F.lit(test_).alias("test"))

    # Both sides in one table: each bucket is seen as a whole once, and each track is summed up once.
    both = shown(reference, False).unionByName(shown(test, True))
    w = Window.partitionBy(*TRACK, "time")
    both = both.withColumns({"tests": F.sum(F.col("test").cast("int")).over(w), "b": F.first(F.when(F.col("test"), F.struct("a")), ignorenulls=True).over(w)["a"]})
    same = F.col("a").eqNullSafe(F.col("b"))
    pair = ~F.col("test") & (F.col("tests") > 0)
    every = both.groupBy(*TRACK).agg(
        F.count_if(~F.col("test")).alias("n_reference"), F.count_if("test").alias("n_test"), (F.max("tests") > 1).alias("twice"), F.count_if(pair).alias("matched"),
        F.sum(F.when(pair, F.when(same, F.lit(0).cast("long")).otherwise(squared_error(F.col("a"), F.col("b"))))).alias("sse"),
        F.sum(F.when(pair, F.when(same, F.lit(0)).otherwise(F.size("a")).cast("long"))).alias("pixels"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    bad = F.coalesce("twice", F.lit(False))
    valid = lambda c: F.when(~bad, zero(F.col(c))).alias(c)
    error = F.when(bad, "Invalid").when(zero(F.col("matched")) == 0, "no_matching_frames")
    return every.select(
        *TRACK, zero(F.col("n_reference")).alias("n_reference"), zero(F.col("n_test")).alias("n_test"), valid("matched"), valid("sse"), valid("pixels"),
        F.when(~bad & (F.col("pixels") > 0), psnr(F.col("sse") / F.nullif(F.col("pixels"), F.lit(0).cast("long")))).alias("psnr"), error.alias("error_category"),
    )


def positional_diff(left: DataFrame, right: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Rows of two tracks by position that differ in a column or have no partner."""
    def placed(df: DataFrame, name: str) -> DataFrame:
        rows = df.withColumn("pos", (F.row_number().over(ordered(order=order)) - 1).cast("long"))
        return rows.select(*TRACK, "pos", F.struct(*columns).alias(name))

    both = placed(left, "a").join(placed(right, "b"), [*TRACK, "pos"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


#: Video codecs and audio codecs that pass.
VIDEO_CODECS, AUDIO_CODECS = ("h264",), ("aac_lc", "aac_lc_sbr")


def validated(samples: DataFrame, settings: DataFrame | None = None, boxes: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """(track_id, n_video, n_audio, error_category): the first rule that a file breaks, or null.

    Video and audio rows are judged each among their own: as many as the cap, codec, no video, no
    keyframe first, edit boxes of either kind, decode order of video, order of audio in both times, size
    of a keyframe group. ``settings``: (track_id, type, codec); ``boxes``: edit boxes with ``type``.
    """
    w = Window.partitionBy(*TRACK, "type").orderBy("idx")
    rows = samples.where(F.col("type").isin("video", "audio"))
    falls = lambda c: F.coalesce(F.col(c) <= F.lag(c).over(w), F.lit(False))
    rows = rows.withColumns({"falls": falls("dts"), "pts_falls": (F.col("type") == "audio") & falls("pts")})
    rows = with_gop(rows.withColumn("keyframe", F.col("keyframe") & (F.col("type") == "video")), block)
    video, audio = F.col("type") == "video", F.col("type") == "audio"
    groups = rows.groupBy(*TRACK, "gop").agg(
        F.count_if(video).alias("v"), F.count_if(audio).alias("a"), F.bool_or(video & F.col("falls")).alias("vf"), F.bool_or(audio & F.col("falls")).alias("af"), F.bool_or("pts_falls").alias("ap")
    )
    tracks = groups.groupBy(*TRACK).agg(
        F.sum("v").alias("n_video"), F.sum("a").alias("n_audio"), F.bool_or("vf").alias("vf"), F.bool_or("af").alias("af"), F.bool_or("ap").alias("ap"),
        F.max(F.when(F.col("gop") > 0, F.col("v"))).alias("longest"), F.coalesce(F.max(F.when(F.col("gop") == 0, F.col("v"))), F.lit(0)).alias("before"),
    )
    none = F.lit(False)
    codec_v = codec_a = none
    if settings is not None:
        codecs = settings.groupBy(*TRACK).agg(F.max(F.when(video, F.col("codec"))).alias("vc"), F.max(F.when(audio, F.col("codec"))).alias("ac"))
        tracks = tracks.join(codecs, TRACK, "left")
        codec_v, codec_a = ~F.coalesce(F.col("vc").isin(*VIDEO_CODECS), none), (F.col("n_audio") > 0) & ~F.coalesce(F.col("ac").isin(*AUDIO_CODECS), none)
    bad_boxes = none
    if boxes is not None:
        listed = boxes.where(F.col("type").isin("video", "audio")).groupBy(*TRACK, "type").agg(box_array().alias("boxes"))
        bad = listed.groupBy(*TRACK).agg(F.bool_or(~valid(F.col("boxes"))).alias("bad_boxes"))
        tracks, bad_boxes = tracks.join(bad, TRACK, "left"), F.coalesce("bad_boxes", none)
    rule = (
        F.when((F.col("n_video") >= MAX_SAMPLES) | (F.col("n_audio") >= MAX_SAMPLES), "too_many_samples")
        .when(codec_v, "video_codec").when(codec_a, "audio_codec").when(F.col("n_video") == 0, "no_video").when(F.col("before") > 0, "no_first_keyframe")
        .when(bad_boxes, "edit_boxes").when(F.col("vf"), "video_dts_order").when(F.col("af"), "audio_dts_order").when(F.col("ap"), "audio_pts_order").when(F.col("longest") > MAX_GOP, "gop_too_long")
    )
    return tracks.select(*TRACK, "n_video", "n_audio", rule.alias("error_category"))
