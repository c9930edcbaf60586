"""Track views over relational tables, each with the SQL that DuckDB runs for the same rows.

A track is an ordered relation: ``(track_id, idx, pts, dts, timescale, keyframe, type, size, nal)``.
The payload is a column of its own, so metadata queries never read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"
DAY = 86_400_000_000
HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One track for each user; decode order is time order, presentation order differs by whole hours. ``more`` names columns of the events to keep."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "signup"), "video").when(F.col("event_type") == "click", "audio").when(F.col("event_type") == "purchase", "data").otherwise("caption")
    return events.select(
        F.col("user_id").alias("track_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("idx"),
        F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts) + (event_id % 7) * {HOUR}").alias("pts"),
        F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)").alias("dts"),
        F.lit(1_000_000).cast("long").alias("timescale"),
        (F.col("event_type") == "signup").alias("keyframe"),
        kind.alias("type"),
        F.octet_length("props").alias("size"),
        F.encode("props", "utf-8").alias("nal"), *more,
    )


SAMPLES = f"""(
    SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
        epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + (event_id % 7) * {HOUR} AS pts,
        epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS dts, 1000000::bigint AS timescale, event_type = 'signup' AS keyframe,
        CASE WHEN event_type IN ('view', 'signup') THEN 'video' WHEN event_type = 'click' THEN 'audio' WHEN event_type = 'purchase' THEN 'data' ELSE 'caption' END AS type,
        strlen(props)::int AS size
    FROM events)"""


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tracks in hour ticks, where neighbours share a tick."""
    tick = F.expr(f"dts div {HOUR}")
    return samples(spark, sf_dir).withColumns({"pts": tick, "dts": tick, "timescale": F.lit(1).cast("long")})


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tracks; in every third one the video's decode times fall now and then by an hour, and sound has its own ticks."""
    rows = samples(spark, sf_dir).drop("nal")
    back = F.when((F.col("track_id") % 3 == 0) & (F.col("type") == "video") & (F.col("idx") % 4 == 1), F.greatest(F.col("dts") - 30 * HOUR, F.lit(0).cast("long"))).otherwise(F.col("dts"))
    sound = F.col("type") == "audio"
    ticks = lambda c: F.when(sound, F.call_function("div", c * 48, F.lit(1000))).otherwise(c)
    return rows.withColumns({"pts": ticks(F.col("pts")), "dts": ticks(back), "timescale": F.when(sound, 48_000).otherwise(F.col("timescale")).cast("long")})


CROSSED = f"""(
    SELECT track_id, idx, type, keyframe, size, CASE WHEN type = 'audio' THEN pts * 48 // 1000 ELSE pts END AS pts,
        CASE WHEN type = 'audio' THEN dts * 48 // 1000 WHEN track_id % 3 = 0 AND type = 'video' AND idx % 4 = 1 THEN greatest(dts - {30 * HOUR}, 0) ELSE dts END AS dts,
        CASE WHEN type = 'audio' THEN 48000 ELSE timescale END::bigint AS timescale
    FROM {SAMPLES})"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks cut into files of seven days."""
    return samples(spark, sf_dir).withColumn("file_ord", F.expr(f"dts div {7 * DAY}"))


CLIPS = f"(SELECT *, dts // {7 * DAY} AS file_ord FROM {SAMPLES})"


def edit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten boxes of a day, every third day, for each track."""
    tracks = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id")).distinct()
    boxes = tracks.select("track_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("ord"))
    return boxes.select(
        "track_id", "ord", (F.col("ord").cast("long") * 3 * DAY).alias("start_pts"), F.lit(DAY).cast("long").alias("duration_pts"), F.lit(1.0).cast("float").alias("rate"), F.lit("video").alias("type")
    )


EDIT_BOXES = f"""(SELECT track_id, ord::int AS ord, ord * 3 * {DAY} AS start_pts, {DAY}::bigint AS duration_pts, 'video' AS type
    FROM (SELECT DISTINCT user_id AS track_id FROM events), range(10) AS r(ord))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of 8 by 8 bytes."""
    quantised = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v.cast("double") + 1.0) * 127.5))).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "label", quantised.alias("plane"))


FRAMES = """(SELECT vec_id AS frame_id, label,
    list_transform(embedding, lambda v: floor(greatest(0.0, least(255.0, (v::double + 1.0) * 127.5)))::int) AS plane FROM embeddings)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as byte payloads."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("/in/"), "source", F.lit("/"), "doc_id", F.lit(".TXT")).alias("path"), F.encode("text", "utf-8").alias("content"))
