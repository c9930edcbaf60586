"""Stitching of files with video, sound and edit boxes, and of chunks whose offsets are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.arith import round_divide, shifted_dts, whole_median
from trackloom.operators.editboxes import box_array, valid
from trackloom.operators.track import TRACK, ordered
from trackloom.operators.transforms import without_overlap_fold
from trackloom.sources.tables import materialise

FILE = [*TRACK, "file_ord"]
#: Settings that all files of a track have to share, by kind.
SHARED = {"video": ("codec", "width", "height", "orientation"), "audio": ("codec", "timescale", "sample_rate", "channels")}


def _before(value: Column) -> Column:
    """Sum over the files before this one."""
    w = Window.partitionBy(*TRACK).orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


def _moved(boxes: str, offset: Column) -> Column:
    return F.transform(boxes, lambda b: F.struct(F.when(b["start"] == -1, b["start"]).otherwise(b["start"] + offset).alias("start"), b["duration"].alias("duration")))


def incompatible(settings: DataFrame) -> DataFrame:
    """(track_id, error_category): tracks of which some file has other settings than the first: an aggregate, every file is only held against the first one's values."""
    first = Window.partitionBy(*TRACK, "type").orderBy("file_ord")
    differs = F.lit(False)
    for kind, columns in SHARED.items():
        for c in columns:
            if c in settings.columns:
                differs = differs | ((F.col("type") == kind) & ~F.col(c).eqNullSafe(F.first(c).over(first)))
    return settings.withColumn("differs", differs).groupBy(*TRACK).agg(F.bool_or("differs").alias("differs")).where("differs").select(*TRACK, F.lit("InvalidArguments").alias("error_category"))


def _in_video_scale() -> dict[str, Column]:
    """Video's times in the first file's timescale (``video_scale``)."""
    scale = lambda c: F.when(F.col("type") == "video", round_divide(F.col(c), F.col("video_scale"), F.col("timescale"))).otherwise(F.col(c))
    return {"pts": scale("pts"), "dts": scale("dts"), "timescale": F.when(F.col("type") == "video", F.col("video_scale")).otherwise(F.col("timescale"))}


def _files(samples: DataFrame, boxes: DataFrame | None, settings: DataFrame | None) -> DataFrame:
    """A row for each file: what its video (v_) and sound (a_) are, where they move to, its boxes, and what is wrong with its track."""
    base = samples.where("type = 'video'").groupBy(*TRACK).agg(F.min_by("timescale", "file_ord").alias("video_scale"))
    rows = samples.where(F.col("type").isin("video", "audio")).join(base, TRACK)
    rows = rows.withColumn("own_scale", F.col("timescale")).withColumns(_in_video_scale())
    keys = [*FILE, "type"]
    stepped = rows.withColumn("delta", F.col("dts") - F.lag("dts").over(ordered(keys)))
    falls = F.coalesce(F.min("delta") < 0, F.lit(False))
    per = stepped.groupBy(*keys).agg(
        F.when(~falls, F.max("dts") - F.min("dts") + whole_median("delta")).alias("duration"), F.when(falls, "Invalid").alias("error_category"), F.min_by("dts", "idx").alias("first"), F.count(F.lit(1)).alias("n"),
        F.max("timescale").alias("scale"), F.max("own_scale").alias("own"), F.max("video_scale").alias("video_scale"),
    )
    of = lambda kind, c: F.max(F.when(F.col("type") == kind, F.col(c)))
    facts = [of(k, c).alias(f"{k[0]}_{c}") for k in ("video", "audio") for c in ("duration", "first", "n", "scale", "error_category")]
    files = per.groupBy(*FILE).agg(*facts, of("video", "own").alias("own_scale"), F.max("video_scale").alias("video_scale"))
    none = F.array().cast("array<struct<start:bigint,duration:bigint>>")
    if boxes is None:
        files = files.withColumns({"v_boxes": none, "a_boxes": none})
    else:
        listed = boxes.where(F.col("type").isin("video", "audio")).groupBy(*FILE, "type").agg(box_array().alias("boxes"))
        listed = listed.groupBy(*FILE).agg(*[F.max_by(F.when(F.col("type") == k, F.col("boxes")), F.col("type") == k).alias(f"{k[0]}_boxes") for k in ("video", "audio")])
        files = files.join(listed, FILE, "left").withColumns({c: F.coalesce(c, none) for c in ("v_boxes", "a_boxes")})
        scaled = F.transform("v_boxes", lambda b: F.struct(F.when(b["start"] == -1, b["start"]).otherwise(round_divide(b["start"], F.col("v_scale"), F.col("own_scale"))).alias("start"), round_divide(b["duration"], F.col("v_scale"), F.col("own_scale")).alias("duration")))
        files = files.withColumn("v_boxes", F.when(F.col("own_scale") == F.col("v_scale"), F.col("v_boxes")).otherwise(scaled))

    track = Window.partitionBy(*TRACK)
    files = files.withColumns({"has_audio": F.max(F.col("a_n").isNotNull()).over(track), "has_boxes": F.max((F.size("v_boxes") > 0) | (F.size("a_boxes") > 0)).over(track), "head": F.min("file_ord").over(track) == F.col("file_ord")})
    empty = lambda c: (F.size(c) > 0) & (F.get(c, F.lit(0))["start"] == -1)
    error = (
        F.when(F.col("v_n").isNull() | (F.col("has_audio") & F.col("a_n").isNull()), "InvalidArguments")
        .when(~valid(F.col("v_boxes")) | ~valid(F.col("a_boxes")), "Invalid")
        .when(~F.col("head") & (empty("v_boxes") | empty("a_boxes")), "InvalidArguments")
        .when(F.col("v_error_category").isNotNull() | ((F.size("a_boxes") > 0) & F.col("a_error_category").isNotNull()), "Invalid")
        .when(F.col("v_duration") == 0, F.when(F.col("v_n") == 1, "Unsupported").otherwise("Invalid"))
        .when(F.col("head") & (F.col("v_first") != 0) & (empty("v_boxes") | empty("a_boxes")), "InvalidArguments")
    )
    total = F.aggregate("v_boxes", F.lit(0).cast("long"), lambda a, b: a + b["duration"])
    in_sound = lambda x: round_divide(x, F.col("a_scale"), F.col("v_scale"))
    counted = F.when(F.size("a_boxes") > 0, F.col("a_duration")).when(F.size("v_boxes") > 0, in_sound(total)).otherwise(in_sound(F.col("v_duration")))
    files = files.withColumns({"error": error, "a_counted": F.when(F.col("has_audio"), counted)})
    first_error = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("file_ord"))).over(track)
    files = files.withColumns({"v_offset": _before(F.col("v_duration")) - F.col("v_first"), "a_offset": _before(F.col("a_counted")) - in_sound(F.col("v_first")), "track_error": first_error})
    if settings is not None:
        files = files.join(incompatible(settings).withColumnRenamed("error_category", "settings_error"), TRACK, "left").withColumn("track_error", F.coalesce("settings_error", "track_error")).drop("settings_error")
    return files


def stitched_files(samples: DataFrame, boxes: DataFrame | None = None, settings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, boxes, tracks): the files (``file_ord``) of each track end to end.

    Video of a file begins where the video before it ends, in the first file's video timescale. Sound begins
    where the sound before it ends, plus the gap to its own file's video; how long a file's sound counts is
    that of its samples if it has edit boxes, else that of the file's video boxes, else that of its video.
    Sound before the beginning goes; sound that overlaps what comes after it goes, from the end. Edit boxes move with
    their samples; if any file has some, files without get one over the whole of them.

    ``tracks``: (track_id, video_duration, audio_duration, error_category). InvalidArguments: a file without video, or
    without sound where another has it, other settings than the first file's, an empty box that isn't in the first file;
    Unsupported: a single picture; Invalid: decode times that fall, boxes that are not valid. Such tracks give no rows.

    Facts are found for each file (a few rows a track) in one pass over the samples and written as a table, which
    samples, boxes and tracks are made from; samples meet it in one equi-join.
    """
    files = materialise(_files(samples, boxes, settings), "files")
    tracks = files.groupBy(*TRACK).agg(F.sum("v_duration").alias("video_duration"), F.sum("a_counted").alias("audio_duration"), F.max("track_error").alias("error_category"))
    tracks = tracks.withColumns({c: F.when(F.col("error_category").isNull(), F.col(c)) for c in ("video_duration", "audio_duration")})
    files = files.where("track_error is null")

    rows = samples.where(F.col("type").isin("video", "audio")).join(files.select(*FILE, "video_scale", "v_offset", "a_offset"), FILE)
    rows = rows.withColumns(_in_video_scale())
    offset = F.when(F.col("type") == "video", F.col("v_offset")).otherwise(F.col("a_offset"))
    moved = rows.withColumn("offset", offset).where("type = 'video' or not (offset < 0 and -offset > pts and -offset > dts)")
    moved = moved.withColumns({"pts": F.col("pts") + F.col("offset"), "dts": F.col("dts") + F.col("offset")}).drop("offset", "v_offset", "a_offset", "video_scale")
    number = F.row_number().over(Window.partitionBy(*TRACK, "type").orderBy("file_ord", "idx"))
    moved = moved.withColumn("idx", (number - 1).cast("long"))
    sound = without_overlap_fold(moved.where("type = 'audio'"))
    video = moved.where("type = 'video'")
    result = video.unionByName(sound.withColumn("idx", (F.row_number().over(Window.partitionBy(*TRACK).orderBy("idx")) - 1).cast("long")))

    spans = []
    for kind in ("video", "audio"):
        k = kind[0]
        length = F.col("v_duration") if k == "v" else F.col("a_counted")
        whole = F.array(F.struct((F.col(f"{k}_first") + F.col(f"{k}_offset")).alias("start"), length.alias("duration")))
        shifted = _moved(f"{k}_boxes", F.col(f"{k}_offset"))
        listed = F.when(F.size(f"{k}_boxes") > 0, shifted).otherwise(whole)
        spans.append(files.where(f"has_boxes and {k}_n is not null").select(*FILE, F.lit(kind).alias("type"), F.posexplode(listed).alias("at", "b")))
    every = spans[0].unionByName(spans[1])
    order = F.row_number().over(Window.partitionBy(*TRACK).orderBy(F.desc("type"), "file_ord", "at"))
    new_boxes = every.select(*TRACK, (order - 1).cast("int").alias("ord"), F.col("b.start").alias("start_pts"), F.col("b.duration").alias("duration_pts"), "type")
    return result, new_boxes, tracks


def unchunked(samples: DataFrame, offsets: DataFrame) -> DataFrame:
    """Chunks (``file_ord``) joined by known offsets (file_ord, audio, video, in seconds): decode times move, presentation times stay.

    A negative sound offset stands for an unknown one and takes the presentation time; a negative video offset, or
    decode times that don't rise, are errors.
    """
    rows = samples.where(F.col("type").isin("video", "audio")).join(F.broadcast(offsets), "file_ord")
    wrong = (F.col("type") == "video") & (F.col("video") < 0)
    offset = F.when(wrong, F.raise_error(F.lit("InvalidArguments: a negative video offset")).cast("double")).when(F.col("type") == "video", F.col("video")).otherwise(F.col("audio"))
    rows = rows.withColumn("dts", shifted_dts(F.col("dts"), F.col("pts"), offset, F.col("timescale"))).drop("audio", "video")
    own = Window.partitionBy(*TRACK, "type").orderBy("file_ord", "idx")
    falls = F.col("dts") <= F.lag("dts").over(own)
    rows = rows.withColumn("dts", F.when(F.coalesce(falls, F.lit(False)), F.raise_error(F.lit("Invalid: decode times don't rise")).cast("long")).otherwise(F.col("dts")))
    return rows.withColumn("idx", (F.row_number().over(own) - 1).cast("long"))
