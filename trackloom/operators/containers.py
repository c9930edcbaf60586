"""Rules that container readers and writers apply to samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.arith import clamp, div, round_divide, to_90khz, whole_median
from trackloom.operators.track import TRACK, ordered, reindexed, running


def open_gops(samples: DataFrame) -> DataFrame:
    """A keyframe counts only if it is presented where it is decoded: the times at its place in presentation order are its own. The first row's always does."""
    rank = F.row_number().over(ordered(order=["pts", "dts", "idx"])) - 1
    shown = samples.select(*TRACK, rank.cast("long").alias("idx"), F.col("pts").alias("shown_pts"), F.col("dts").alias("shown_dts"))
    same = (F.col("idx") == 0) | ((F.col("pts") == F.col("shown_pts")) & (F.col("dts") == F.col("shown_dts")))
    return samples.join(shown, [*TRACK, "idx"]).withColumn("keyframe", F.col("keyframe") & same).drop("shown_pts", "shown_dts")


def from_first_keyframe(samples: DataFrame) -> DataFrame:
    """Rows before a track's first keyframe go; a track without one goes wholly."""
    first = F.min(F.when(F.col("keyframe"), F.col("idx"))).over(Window.partitionBy(*TRACK))
    return reindexed(samples.withColumn("__first", first).where("idx >= __first").drop("__first"))


def transport_duration(samples: DataFrame, sample_rate: int) -> DataFrame:
    """(track, type, duration) in 90 kHz of packets (``packet``): the steps between packets and a guess for what follows the last one.

    The guess is computed for sound, 1024 frames for each sample of the last packet, and the median of the
    steps for all else, where a packet is one sample.
    """
    packets = samples.groupBy(*TRACK, "type", "packet").agg(F.min_by("dts", "idx").alias("dts"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*TRACK, "type").orderBy("packet")
    steps = packets.select(*TRACK, "type", "packet", "n", (F.col("dts") - F.lag("dts").over(w)).alias("delta"))
    sound = round_divide(F.max_by("n", "packet") * (90000 * 1024), 1, sample_rate)
    last = F.when(F.col("type") == "audio", F.col("sound")).otherwise(F.col("middle"))
    sums = steps.groupBy(*TRACK, "type").agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("steps"), sound.alias("sound"), whole_median("delta").alias("middle"))
    return sums.select(*TRACK, "type", (F.col("steps") + last).alias("duration"))


def interpolated(samples: DataFrame, packet: list[str], sample_rate: int) -> DataFrame:
    """Times of samples that share a packet: the first one's, plus 1024 sound frames for each before."""
    w = Window.partitionBy(*packet).orderBy("idx")
    k = (F.row_number().over(w) - 1).cast("long")
    return samples.withColumns({c: F.first(c).over(w) + div(k * (90000 * 1024), sample_rate) for c in ("pts", "dts")})


def frame_times(delays: DataFrame, delay: Column, keys: list[str]) -> DataFrame:
    """Frame delays in ms (below 20 become 100, at most 5000) and the time at which each frame begins."""
    clamped = F.when(delay < 20, 100).otherwise(F.least(delay, F.lit(5000))).cast("long")
    before = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return delays.withColumn("delay", clamped).withColumn("pts", F.coalesce(F.sum("delay").over(before), F.lit(0)))


def written(samples: DataFrame) -> DataFrame:
    """Re-based decode times, the length of each sample (the last repeats the one before, else 1), and whether the order is broken."""
    w = ordered()
    first = F.first("dts").over(w)
    step = F.lead("dts").over(w) - F.col("dts")
    back = F.nullif(F.col("dts") - F.lag("dts").over(w), F.lit(0).cast("long"))
    return samples.withColumns({"dts0": F.col("dts") - first, "length": F.coalesce(step, back, F.lit(1).cast("long")), "broken": F.coalesce(F.col("dts") <= F.lag("dts").over(w), F.lit(False))})


def transport_times(samples: DataFrame) -> DataFrame:
    return samples.withColumns({c: to_90khz(F.col(c), F.col("timescale")) for c in ("pts", "dts")})


def bitrate(bytes_: Column, duration: Column, timescale: Column) -> Column:
    """kbit/s."""
    return (bytes_ * timescale * 8).cast("double") / (F.nullif(duration, F.lit(0).cast("long")) * 1000)


def fps(count: Column, duration: Column, timescale: Column) -> Column:
    return F.when(duration == 0, F.lit(0.0)).otherwise(count.cast("double") / duration * timescale)


def gop_range(samples: DataFrame, start: int, count: int) -> DataFrame:
    """Rows from the ``start``-th keyframe's decode time to that of the one ``count`` further."""
    keys = samples.where("keyframe").select(*TRACK, F.col("dts").alias("from"), (F.row_number().over(ordered()) - 1).alias("k"), F.lead("dts", count).over(ordered()).alias("to"))
    limits = keys.where(F.col("k") == start).select(*TRACK, "from", "to")
    return samples.join(limits, TRACK).where("dts >= from and (to is null or dts < to)").drop("from", "to")


# ---------------------------------------------------------------- sound

def coalesced_pcm(samples: DataFrame, frame_bytes: int) -> DataFrame:
    """Neighbouring raw sound samples (``pos``, ``size``) as pieces of at most a whole frame: a piece ends where bytes aren't contiguous or a frame is full.

    (track, piece, first_idx, n, pts, dts, pos, size, keyframe): a piece is a keyframe only if its first
    sample is and it begins at a multiple of the frame's bytes.
    """
    w = ordered()
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = ~F.coalesce(F.col("pos") == F.lag("pos").over(w) + F.lag("size").over(w), F.lit(False))
    rows = samples.withColumns({"before": before, "starts": apart | (before % frame_bytes == 0)})
    rows = running(rows, F.col("starts").cast("long"), "piece")
    return rows.groupBy(*TRACK, (F.col("piece") - 1).alias("piece")).agg(
        F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n"), F.min_by("pts", "idx").alias("pts"), F.min_by("dts", "idx").alias("dts"), F.min_by("pos", "idx").alias("pos"), F.sum("size").alias("size"),
        F.min_by(F.col("keyframe") & (F.col("before") % frame_bytes == 0), "idx").alias("keyframe"),
    )


def packed_sounds(samples: DataFrame, frame_bytes: int) -> DataFrame:
    """Which sound each run of bytes falls into, how many bytes of silence fill up the last one, and whether a row crosses a border, which is Unsupported."""
    rows = running(samples, F.col("size").cast("long"), "cum")
    bucket, start = div(F.col("cum") - 1, frame_bytes), div(F.col("cum") - F.col("size"), frame_bytes)
    total = F.max("cum").over(Window.partitionBy(*TRACK))
    silence = F.when(F.col("cum") == total, F.pmod(-total, F.lit(frame_bytes))).otherwise(F.lit(0).cast("long"))
    return rows.withColumns({"sound": bucket, "straddles": (F.col("size") > 0) & (bucket != start), "silence": silence}).drop("cum")


def decoded_pcm(content: Column, bits: int = 16, little: bool = True) -> Column:
    """Raw sound bytes as an array of 16-bit samples; of 24 bits the upper two bytes are kept."""
    width = bits // 8
    high, low = (width - 1, width - 2) if little else (0, 1)
    at = lambda i, k: F.conv(F.hex(F.substring(content, (i * width + k + 1).cast("int"), 1)), 16, 10).cast("int")

    def sample(i: Column) -> Column:
        value = at(i, high) * 256 + at(i, low)
        return F.when(value > 32767, value - 65536).otherwise(value)

    n = div(F.octet_length(content), width)
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), sample))


def mono(stereo: Column) -> Column:
    """Left and right added, kept within 16 bits."""
    n = F.size(stereo)
    pairs = F.sequence(F.lit(0), div(n, 2) - 1)
    return F.when(n < 2, F.array().cast("array<int>")).otherwise(F.transform(pairs, lambda i: clamp(F.get(stereo, i * 2) + F.get(stereo, i * 2 + 1), F.lit(-32768), F.lit(32767)).cast("int")))


def halved(samples: Column) -> Column:
    """Half the rate: the mean of neighbours, truncated."""
    n = F.size(samples)
    return F.when(n < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), div(n, 2) - 1), lambda i: div(F.get(samples, i * 2) + F.get(samples, i * 2 + 1), 2).cast("int")))
