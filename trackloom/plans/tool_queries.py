"""Queries that do what the command-line tools do: list, remux, join chunks, stitch, compare by time, prepare decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import compare, containers, editboxes, stitching, tools, transforms
from trackloom.operators.track import reindexed
from trackloom.plans.catalog import query
from trackloom.plans.track_queries import LENGTH_MS, REAL_PTS, START_MS, TRIMMED
from trackloom.sources import mp4, views
from trackloom.sources.tables import materialise
from trackloom.sources.views import CROSSED, DAY, EDIT_BOXES, SAMPLES

# ---------------------------------------------------------------- stitching

#: Files of seven days: video in microseconds, in every second file in half as many ticks; sound at 48 kHz; boxes over the middle days of files 0 and 2 of even tracks.
AV = f"""(
    SELECT track_id, file_ord, idx, type, CASE WHEN type = 'audio' THEN dts * 48 // 1000 WHEN file_ord % 2 = 1 THEN dts // 2 ELSE dts END AS dts,
        CASE WHEN type = 'audio' THEN 48000 WHEN file_ord % 2 = 1 THEN 500000 ELSE 1000000 END AS timescale
    FROM (SELECT *, dts // {7 * DAY} AS file_ord FROM {SAMPLES} WHERE type IN ('audio', 'video')))"""
_STITCH = f"""
    r AS (SELECT track_id, file_ord, idx, type, CASE WHEN type = 'video' AND timescale <> s THEN (dts * s + timescale // 2) // timescale ELSE dts END AS dts, s
        FROM {AV} JOIN (SELECT track_id, arg_min(timescale, file_ord) FILTER (type = 'video') AS s FROM {AV} GROUP BY track_id) USING (track_id)),
    x AS (SELECT *, dts - lag(dts) OVER (PARTITION BY track_id, file_ord, type ORDER BY idx) AS delta FROM r),
    p AS (SELECT track_id, file_ord, type, (max(dts) - min(dts) + coalesce(floor(median(delta)), 0))::bigint AS duration, min(dts) AS first, count(*) AS n, any_value(s) AS s FROM x GROUP BY ALL),
    f AS (
        SELECT track_id, file_ord, max(duration) FILTER (type = 'video') AS vd, max(first) FILTER (type = 'video') AS vf, max(n) FILTER (type = 'video') AS vn, max(n) FILTER (type = 'audio') AS an, max(first) FILTER (type = 'audio') AS af,
            any_value(s) AS s, track_id % 2 = 0 AND file_ord IN (0, 2) AS boxed FROM p GROUP BY ALL),
    e AS (
        SELECT track_id, arg_min(error, file_ord) FILTER (error IS NOT NULL) AS error_category FROM (SELECT track_id, file_ord, CASE WHEN vn IS NULL OR an IS NULL THEN 'InvalidArguments' WHEN vd = 0 THEN 'Unsupported' END AS error FROM f) GROUP BY track_id),
    c AS (SELECT *, (CASE WHEN boxed THEN (CASE WHEN s = 1000000 OR file_ord % 2 = 0 THEN {3 * DAY} ELSE 0 END * s // 1000000 * 48000 + s // 2) // s ELSE (vd * 48000 + s // 2) // s END)::bigint AS ad, (vf * 48000 + s // 2) // s AS lead FROM f),
    o AS (
        SELECT *, (sum(vd) OVER w - vd)::bigint - vf AS vo, (sum(ad) OVER w - ad)::bigint - lead AS ao FROM c JOIN e USING (track_id) WHERE error_category IS NULL WINDOW w AS (PARTITION BY track_id ORDER BY file_ord))"""


def av_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = views.clips(spark, sf_dir).drop("nal").where("type in ('audio', 'video')")
    half = (F.col("type") == "video") & (F.col("file_ord") % 2 == 1)
    dts = F.when(F.col("type") == "audio", F.expr("dts * 48 div 1000")).when(half, F.expr("dts div 2")).otherwise(F.col("dts"))
    scale = F.when(F.col("type") == "audio", 48_000).when(half, 500_000).otherwise(1_000_000).cast("long")
    rows = rows.withColumns({"dts": dts, "pts": dts, "timescale": scale})
    boxed = rows.where("type = 'video' and track_id % 2 = 0 and file_ord in (0, 2)").select("track_id", "file_ord").distinct()
    boxes = boxed.select("track_id", "file_ord", F.lit(0).alias("ord"), (F.col("file_ord") * 7 * DAY + 2 * DAY).alias("start_pts"), F.lit(3 * DAY).cast("long").alias("duration_pts"), F.lit("video").alias("type"))
    return rows, boxes


@query("stitch_av", f"""
    WITH {_STITCH},
    m AS (SELECT track_id, file_ord, idx, type, dts + CASE WHEN type = 'video' THEN vo ELSE ao END AS dts, CASE WHEN type = 'video' THEN vo ELSE ao END AS moved, dts AS was FROM r JOIN o USING (track_id, file_ord)),
    k AS (SELECT * FROM m WHERE type = 'video' OR NOT (moved < 0 AND -moved > was)),
    n AS (SELECT *, min(dts) OVER (PARTITION BY track_id, type ORDER BY file_ord, idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM k)
    SELECT track_id, type, file_ord, row_number() OVER (PARTITION BY track_id, type ORDER BY file_ord, idx) - 1 AS idx, dts FROM n WHERE type = 'video' OR later IS NULL OR dts < later""")
def stitch_av(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = stitching.stitched_files(*av_files(spark, sf_dir))
    return rows.select("track_id", "type", "file_ord", "idx", "dts")


@query("stitch_boxes", f"""
    WITH {_STITCH},
    h AS (SELECT track_id FROM o GROUP BY track_id HAVING bool_or(boxed)),
    b AS (
        SELECT track_id, file_ord, 'video' AS type, CASE WHEN boxed THEN (file_ord * {7 * DAY} + {2 * DAY}) * s // 1000000 + vo ELSE vf + vo END AS start_pts, CASE WHEN boxed THEN {3 * DAY} * s // 1000000 ELSE vd END AS duration_pts FROM o SEMI JOIN h USING (track_id)
        UNION ALL SELECT track_id, file_ord, 'audio', af + ao, ad FROM o SEMI JOIN h USING (track_id))
    SELECT track_id, (row_number() OVER (PARTITION BY track_id ORDER BY type DESC, file_ord) - 1)::int AS ord, start_pts::bigint AS start_pts, duration_pts::bigint AS duration_pts, type FROM b""")
def stitch_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitching.stitched_files(*av_files(spark, sf_dir))[1]


@query("stitch_durations", f"""
    WITH {_STITCH} SELECT track_id, (sum(vd) FILTER (error_category IS NULL))::bigint AS video_duration, (sum(ad) FILTER (error_category IS NULL))::bigint AS audio_duration, any_value(error_category) AS error_category
    FROM c JOIN e USING (track_id) GROUP BY track_id""")
def stitch_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitching.stitched_files(*av_files(spark, sf_dir))[2]


@query("stitch_settings", f"SELECT DISTINCT track_id, 'InvalidArguments' AS error_category FROM {SAMPLES} WHERE track_id % 4 = 1 AND dts >= {7 * DAY} AND type = 'audio' AND track_id IN (SELECT track_id FROM {SAMPLES} WHERE dts < {7 * DAY} AND type = 'audio')")
def stitch_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.clips(spark, sf_dir).where("type in ('audio', 'video')").select("track_id", "file_ord", "type").distinct()
    return stitching.incompatible(files.withColumns({"codec": F.lit("aac_lc"), "channels": F.when((F.col("track_id") % 4 == 1) & (F.col("file_ord") > 0), 1).otherwise(2)}))


@query("unchunk", f"""
    WITH c AS (SELECT *, dts // {7 * DAY} AS file_ord FROM {SAMPLES} WHERE type IN ('audio', 'video'))
    SELECT track_id, type, row_number() OVER (PARTITION BY track_id, type ORDER BY file_ord, idx) - 1 AS idx, pts, (CASE WHEN type = 'audio' THEN dts + file_ord * 500000 ELSE dts + file_ord * 250000 END)::bigint AS dts FROM c""")
def unchunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = spark.range(8).selectExpr("id as file_ord", "id * 0.5D as audio", "id * 0.25D as video")
    rows = stitching.unchunked(views.clips(spark, sf_dir).drop("nal"), offsets)
    return rows.select("track_id", "type", "idx", "pts", "dts")


# ---------------------------------------------------------------- comparing by time

_PLANE = "[size % 256, (idx * 7) % 256, file % 256, 128]"
_NOISY = f"(SELECT track_id, idx, pts, [(size + idx % 3) % 256, (idx * 7) % 256, file % 256, 128] AS plane FROM (SELECT *, pts // {DAY} AS file FROM {SAMPLES}) WHERE type = 'video' AND (track_id % 9 = 0 OR idx % 5 <> 0))"
_SHOWN = """(
    SELECT s.track_id, s.idx, plane, trunc(p.real_pts::real * 100::real / {scale}::real)::bigint AS time FROM {rows} s JOIN {real} p USING (track_id, idx) WHERE p.real_pts >= 0)"""
_SSE = "list_sum(list_transform(range(1, 5), lambda i: (a.plane[i] - b.plane[i]) * (a.plane[i] - b.plane[i])))"


@query("psnr_buckets", f"""
    WITH one AS (SELECT * FROM {_SHOWN.format(rows=f"(SELECT track_id, idx, pts, {_PLANE} AS plane FROM (SELECT *, pts // {DAY} AS file FROM {SAMPLES}) WHERE type = 'video')", real=REAL_PTS, scale=1000000)}),
    two AS (SELECT * FROM {_SHOWN.format(rows=_NOISY, real=REAL_PTS, scale=1000000)}),
    a AS (SELECT track_id, count(*) AS n_reference FROM one GROUP BY track_id),
    t AS (SELECT track_id, sum(n)::bigint AS n_test, max(n) > 1 AS twice FROM (SELECT track_id, time, count(*) AS n FROM two GROUP BY ALL) GROUP BY track_id),
    m AS (
        SELECT a.track_id, count(*) AS matched, sum(CASE WHEN a.plane = b.plane THEN 0 ELSE {_SSE} END)::bigint AS sse, sum(CASE WHEN a.plane = b.plane THEN 0 ELSE 4 END)::bigint AS pixels
        FROM one a JOIN (SELECT track_id, time, any_value(plane) AS plane FROM two GROUP BY ALL) b USING (track_id, time) GROUP BY a.track_id)
    SELECT track_id, coalesce(n_reference, 0) AS n_reference, coalesce(n_test, 0) AS n_test, CASE WHEN NOT bad THEN coalesce(matched, 0) END AS matched, CASE WHEN NOT bad THEN coalesce(sse, 0) END AS sse, CASE WHEN NOT bad THEN coalesce(pixels, 0) END AS pixels,
        CASE WHEN NOT bad AND pixels > 0 AND sse > 0 THEN round(10 * log10(65025 / (sse / pixels)), 6) END AS psnr, CASE WHEN bad THEN 'Invalid' WHEN coalesce(matched, 0) = 0 THEN 'no_matching_frames' END AS error_category
    FROM (SELECT *, coalesce(twice, false) AS bad FROM a FULL JOIN t USING (track_id) LEFT JOIN m USING (track_id))""")
def psnr_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = editboxes.with_real_pts(views.samples(spark, sf_dir).where("type = 'video'").drop("nal"), views.edit_boxes(spark, sf_dir))
    plane = lambda noise: F.array((F.col("size") + noise) % 256, F.col("idx") * 7 % 256, F.expr(f"pts div {DAY} % 256"), F.lit(128).cast("long"))
    test = rows.where("track_id % 9 = 0 or idx % 5 <> 0").withColumn("plane", plane(F.col("idx") % 3))
    return compare.bucket_quality(rows.withColumn("plane", plane(F.lit(0).cast("long"))), test).withColumn("psnr", F.round("psnr", 6))


# ---------------------------------------------------------------- listing and remuxing

@query("frame_listing", f"SELECT track_id, s.idx, s.pts, s.dts, keyframe, (real_pts::real::double / 1000000::double)::real::double + 0.0::double AS play_time FROM {SAMPLES} s JOIN {REAL_PTS} USING (track_id, idx) WHERE type = 'video'")
def frame_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tools.frame_listing(views.samples(spark, sf_dir).where("type = 'video'").drop("nal"), views.edit_boxes(spark, sf_dir))
    return rows.select("track_id", "idx", "pts", "dts", "keyframe", (F.col("play_time").cast("double") + 0.0).alias("play_time"))


@query("track_listing", f"""
    WITH x AS (SELECT *, dts - lag(dts) OVER (PARTITION BY track_id, type ORDER BY idx) AS delta FROM {SAMPLES})
    SELECT track_id, type, count(*) AS n, (max(dts) - min(dts) + coalesce(floor(median(delta)), 0))::bigint AS duration, round((max(dts) - min(dts) + coalesce(floor(median(delta)), 0)) / 1000000, 6) AS seconds,
        round(sum(size) * 1000000 * 8 / (nullif(max(dts) - min(dts) + coalesce(floor(median(delta)), 0), 0) * 1000), 9) AS kbps FROM x GROUP BY ALL""")
def track_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tools.track_listing(views.samples(spark, sf_dir).drop("nal"))
    return rows.withColumns({"seconds": F.round("seconds", 6), "kbps": F.round("kbps", 9)})


@query("byte_order", f"""
    WITH p AS (SELECT *, (idx * 37) % 101 AS pos FROM {SAMPLES} WHERE type IN ('video', 'audio'))
    SELECT track_id, idx, type, row_number() OVER (PARTITION BY track_id ORDER BY pos, type, idx) - 1 AS place, row_number() OVER (PARTITION BY track_id, type ORDER BY pos, idx) - 1 AS nth FROM p""")
def byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir).drop("nal").withColumn("pos", F.col("idx") * 37 % 101)
    return tools.byte_order(rows).select("track_id", "idx", "type", "place", "nth")


_LIMITS = f"""
    k AS (SELECT track_id, dts, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS k FROM {CROSSED} WHERE type = 'video' AND keyframe),
    l AS (SELECT track_id, max(dts) FILTER (k = 1) AS low, max(dts) FILTER (k = 3) AS high FROM k GROUP BY track_id HAVING max(dts) FILTER (k = 1) IS NOT NULL)"""


@query("remux_gops", f"""
    WITH {_LIMITS}
    SELECT track_id, type, row_number() OVER (PARTITION BY track_id, type ORDER BY idx) - 1 AS idx, pts, dts FROM {CROSSED} JOIN l USING (track_id)
    WHERE type IN ('video', 'audio', 'caption') AND dts >= CASE WHEN type = 'audio' THEN (low * 48000 + 500000) // 1000000 ELSE low END
        AND (high IS NULL OR dts < CASE WHEN type = 'audio' THEN (high * 48000 + 500000) // 1000000 ELSE high END)""")
def remux_gops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = tools.remuxed(views.crossed(spark, sf_dir), views.edit_boxes(spark, sf_dir), 1, 2)
    return rows.select("track_id", "type", "idx", "pts", "dts")


@query("remux_boxes", f"""
    WITH g AS (SELECT track_id, count(*) AS g FROM {CROSSED} WHERE type = 'video' AND keyframe GROUP BY track_id)
    SELECT track_id, ord, start_pts, duration_pts FROM {EDIT_BOXES} b JOIN g USING (track_id) WHERE g <= 12""")
def remux_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.remuxed(views.crossed(spark, sf_dir), views.edit_boxes(spark, sf_dir), 0, 12)[1].select("track_id", "ord", "start_pts", "duration_pts")


@query("trim_boxes", f"""
    WITH e AS (SELECT track_id, min(start_pts) AS low, max(start_pts + duration_pts) AS high FROM {TRIMMED} GROUP BY track_id),
    s AS (SELECT s.*, low, high, min(idx) FILTER (pts >= low) OVER (PARTITION BY track_id) AS first, max(idx) FILTER (pts < high) OVER (PARTITION BY track_id) AS last FROM {SAMPLES} s JOIN e USING (track_id)),
    k AS (SELECT track_id, any_value(low) AS low, any_value(first) AS first, any_value(last) AS last, coalesce(max(idx) FILTER (keyframe AND idx <= first AND pts <= low), min(idx) FILTER (keyframe)) AS key FROM s GROUP BY track_id)
    SELECT t.track_id, t.ord, t.start_pts - b.dts AS start_pts, t.duration_pts FROM {TRIMMED} t JOIN k USING (track_id) JOIN {SAMPLES} b ON b.track_id = t.track_id AND b.idx = key
    WHERE k.first >= key AND k.last >= k.first AND b.dts <= low AND k.last > key""")
def trim_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.trim(views.samples(spark, sf_dir), views.edit_boxes(spark, sf_dir), START_MS, LENGTH_MS)[1]


# ---------------------------------------------------------------- edit boxes of files

_MOVIE = f"(SELECT track_id, count(*) * {DAY} // 10 AS duration, (count(*) % 12 + 1) * 86400 * 600 AS playback FROM {SAMPLES} GROUP BY track_id)"


@query("edit_boxes_load", f"""
    WITH e AS (
        SELECT track_id, ord, CASE WHEN ord = 4 AND track_id % 3 = 0 THEN -1 ELSE start_pts END AS start, CASE WHEN ord % 4 = 0 THEN (duration * 600 + 500000) // 1000000 ELSE 86400 * 600 + ord END AS edit, ord % 4 = 0 AS implicit, playback
        FROM {EDIT_BOXES} JOIN {_MOVIE} USING (track_id)),
    k AS (SELECT *, (edit * 1000000 + 300) // 600 AS duration_pts FROM e WHERE NOT (implicit AND start = -1)),
    b AS (SELECT *, sum(duration_pts) OVER (PARTITION BY track_id ORDER BY ord) - duration_pts AS before FROM k)
    SELECT track_id, (row_number() OVER (PARTITION BY track_id ORDER BY ord) - 1)::int AS ord, start AS start_pts, duration_pts FROM b WHERE before < (playback * 1000000 + 300) // 600""")
def edit_boxes_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = views.edit_boxes(spark, sf_dir).selectExpr(
        "track_id", "ord", "if(ord = 4 and track_id % 3 = 0, -1L, start_pts) as start", "if(ord % 4 = 0, null, 86400L * 600 + ord) as duration"
    )
    tracks = views.samples(spark, sf_dir).groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "track_id", "'video' as type", "1000000L as timescale", "600L as movie_timescale", f"n * {DAY} div 10 as duration", "(n % 12 + 1) * 86400L * 600 as playback_duration"
    )
    return editboxes.loaded(edits, tracks).select("track_id", "ord", "start_pts", "duration_pts")


@query("edit_boxes_write", f"SELECT track_id, type, ord, start_pts AS start_time, ((duration_pts + ord) * 600 // 1000000)::bigint AS duration FROM {EDIT_BOXES}")
def edit_boxes_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = views.edit_boxes(spark, sf_dir).withColumn("duration_pts", F.col("duration_pts") + F.col("ord"))
    tracks = boxes.select("track_id", "type").distinct().withColumns({"timescale": F.lit(1_000_000).cast("long"), "movie_timescale": F.lit(600).cast("long")})
    return editboxes.written(boxes, tracks)


@query("edit_boxes_shift", f"SELECT track_id, ord, start_pts + 5000 AS start_pts, duration_pts, (sum(duration_pts) OVER (PARTITION BY track_id))::bigint AS total FROM {EDIT_BOXES} WHERE type = 'video'")
def edit_boxes_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = editboxes.of_type(views.edit_boxes(spark, sf_dir), "video")
    moved = editboxes.shifted(boxes, F.lit(5000).cast("long")).join(editboxes.total(boxes).withColumnRenamed("duration", "total"), "track_id")
    return moved.select("track_id", "ord", "start_pts", "duration_pts", "total")


@query("include_range", f"""
    WITH i AS (SELECT *, (1000::real * real_pts::real / 1000000::real)::real AS t FROM {REAL_PTS} WHERE real_pts >= 0),
    k AS (SELECT * FROM i WHERE t >= 86400000::real AND t < 345600000::real)
    SELECT track_id, idx, pts, real_pts FROM k JOIN (SELECT track_id, arg_min(real_pts, idx) AS first FROM k GROUP BY track_id) USING (track_id) WHERE real_pts >= first""")
def include_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = editboxes.included(views.samples(spark, sf_dir).drop("nal"), views.edit_boxes(spark, sf_dir), 86_400_000, 259_200_000)
    return rows.select("track_id", "idx", "pts", "real_pts")


# ---------------------------------------------------------------- decoding

@query("decode_start", f"SELECT track_id, idx, max(CASE WHEN keyframe THEN idx END) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS start FROM {SAMPLES}")
def decode_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.decode_start(views.samples(spark, sf_dir), 16).select("track_id", "idx", "start")


@query("frame_linger", """
    WITH f AS (SELECT conv_id, turn AS idx, turn * 100 AS pts, turn = max(turn) OVER (PARTITION BY conv_id) AND count(*) OVER (PARTITION BY conv_id) > 1 AS last FROM conversations)
    SELECT conv_id, idx, pts FROM f UNION ALL SELECT conv_id, idx + k, pts + k FROM f, range(1, 3) AS r(k) WHERE last""")
def frame_linger(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = views.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), (F.col("turn") * 100).alias("pts"))
    return tools.lingering(turns, ["conv_id"])


@query("pcm_coalesce", f"""
    WITH a AS (SELECT track_id, row_number() OVER w - 1 AS idx, pts, dts, (row_number() OVER w - 1) * 4 + (row_number() OVER w - 1) // 11 * 8 AS pos FROM {SAMPLES} WHERE type = 'audio' WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
    p AS (SELECT *, idx // 11 * 100 + CASE WHEN idx % 11 = 0 THEN 0 ELSE (idx // 8) + 1 - (idx // 11 * 11) // 8 END AS g, sum(CASE WHEN idx % 11 = 0 OR idx % 8 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY idx) AS piece FROM a)
    SELECT track_id, (piece - 1)::bigint AS piece, min(idx) AS first_idx, count(*) AS n, arg_min(pts, idx) AS pts, arg_min(dts, idx) AS dts, min(pos) AS pos, (count(*) * 4)::bigint AS size, min(idx) % 8 = 0 AS keyframe FROM p GROUP BY track_id, piece""")
def pcm_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = views.samples(spark, sf_dir).where("type = 'audio'").drop("nal")
    rows = reindexed(sound).withColumns({"pos": F.expr("idx * 4 + idx div 11 * 8"), "size": F.lit(4), "keyframe": F.lit(True)})
    return containers.coalesced_pcm(rows, 32)


@query("parameter_changes", f"""
    WITH v AS (SELECT track_id, idx, size // 4 AS v FROM {SAMPLES} WHERE keyframe), n AS (SELECT track_id, v IS DISTINCT FROM lag(v) OVER (PARTITION BY track_id ORDER BY idx) AS fresh FROM v)
    SELECT track_id, count(*) FILTER (fresh) AS changes FROM n GROUP BY track_id""")
def parameter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.parameter_changes(views.samples(spark, sf_dir).drop("nal"), F.when(F.col("keyframe"), F.expr("size div 4")))


@query("work_parts", f"""
    WITH RECURSIVE v AS (SELECT track_id, dts, keyframe, max(dts) OVER (PARTITION BY track_id) AS final FROM {SAMPLES} WHERE type = 'video'),
    k AS (SELECT track_id, dts, (final + 1) // 3 AS share, row_number() OVER (PARTITION BY track_id ORDER BY dts) AS n FROM v WHERE keyframe AND dts < final),
    c AS (
        SELECT DISTINCT track_id, 0::bigint AS n, 0::bigint AS cut, true AS cuts FROM k
        UNION ALL SELECT k.track_id, k.n, CASE WHEN k.dts > cut + share THEN k.dts ELSE cut END, k.dts > cut + share FROM c JOIN k ON k.track_id = c.track_id AND k.n = c.n + 1),
    p AS (SELECT v.track_id, v.dts, count(*) - 1 AS part FROM v JOIN c ON c.track_id = v.track_id AND cuts AND cut <= v.dts GROUP BY v.track_id, v.dts)
    SELECT track_id, part::int AS part, min(dts) AS first_dts, max(dts) AS last_dts, count(*) AS n FROM v JOIN p USING (track_id, dts) GROUP BY ALL""")
def work_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.work_parts(views.samples(spark, sf_dir).drop("nal"), 3)


@query("mp4_tables", f"""
    WITH v AS (SELECT track_id, row_number() OVER w - 1 AS idx, dts // 1000 AS dts, pts // 1000 - dts // 1000 AS off, size, keyframe FROM {SAMPLES} WHERE type = 'video' WINDOW w AS (PARTITION BY track_id ORDER BY idx))
    SELECT track_id, idx, dts - first_value(dts) OVER w + off AS pts, dts - first_value(dts) OVER w AS dts, keyframe, (sum(size) OVER w - size)::bigint AS pos, size::bigint AS size, 'video' AS type, 1000::bigint AS timescale FROM v WINDOW w AS (PARTITION BY track_id ORDER BY idx)""")
def mp4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = reindexed(views.samples(spark, sf_dir).where("type = 'video'").drop("nal")).selectExpr("track_id", "idx", "pts div 1000 as pts", "dts div 1000 as dts", "size", "keyframe", "1000L as timescale")
    files = materialise(mp4.written(video), "mp4")
    return mp4.sample_tables(files, "track_id").drop("trak")
