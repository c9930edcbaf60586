"""Queries over tracks: groups, ranges, edit lists, trimming, stitching, merging, comparing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import compare, containers, editboxes, track, transforms
from trackloom.plans.catalog import query
from trackloom.sources import views
from trackloom.sources.views import CLIPS, CROSSED, DAY, EDIT_BOXES, HOUR, SAMPLES

BLOCK = 4096
GOPS = f"(SELECT *, sum(keyframe::int) OVER (PARTITION BY track_id ORDER BY idx)::bigint AS gop FROM {SAMPLES})"
DELTAS = f"(SELECT *, dts - lag(dts) OVER (PARTITION BY track_id ORDER BY idx) AS delta FROM {SAMPLES})"
DURATIONS = f"(SELECT track_id, (max(dts) - min(dts) + coalesce(floor(median(delta)), 0))::bigint AS duration FROM {DELTAS} GROUP BY track_id)"


@query("gop_stats", f"""
    SELECT track_id, gop, count(*) AS n, sum(size)::bigint AS bytes, min(dts) AS first_dts, max(dts) AS last_dts
    FROM {GOPS} WHERE gop > 0 GROUP BY track_id, gop""")
def gop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track.with_gop(views.samples(spark, sf_dir).drop("nal"), BLOCK)
    return rows.where("gop > 0").groupBy("track_id", "gop").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("dts").alias("first_dts"), F.max("dts").alias("last_dts"))


@query("keyframes", f"SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS idx, pts, dts FROM {SAMPLES} WHERE keyframe")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.keep(views.samples(spark, sf_dir), F.col("keyframe")).select("track_id", "idx", "pts", "dts")


@query("index_slice", f"SELECT track_id, idx, pts FROM {SAMPLES} WHERE idx >= 5 AND idx < 20")
def index_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.bounds(views.samples(spark, sf_dir), 5, 20).select("track_id", "idx", "pts")


@query("shift_samples", f"SELECT track_id, idx, pts + 1000 AS pts, dts + 1000 AS dts FROM {SAMPLES}")
def shift_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.shifted(views.samples(spark, sf_dir), F.lit(1000).cast("long")).select("track_id", "idx", "pts", "dts")


@query("dts_range_remux", f"""
    WITH k AS (SELECT track_id, dts AS a, row_number() OVER w - 1 AS k, lead(dts, 2) OVER w AS b FROM {SAMPLES} WHERE keyframe WINDOW w AS (PARTITION BY track_id ORDER BY idx))
    SELECT s.track_id, idx, dts FROM {SAMPLES} s JOIN k ON s.track_id = k.track_id AND k.k = 1 AND dts >= a AND (b IS NULL OR dts < b)""")
def dts_range_remux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.gop_range(views.samples(spark, sf_dir), 1, 2).select("track_id", "idx", "dts")


@query("track_duration", f"SELECT * FROM {DURATIONS}")
def track_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.durations(views.samples(spark, sf_dir)).select("track_id", "duration")


@query("transport_duration", f"""
    WITH s AS (SELECT track_id, type, idx, dts * 90000 // 1000000 AS dts, CASE WHEN type = 'audio' THEN idx // 4 ELSE idx END AS packet FROM {SAMPLES}),
    p AS (SELECT track_id, type, packet, arg_min(dts, idx) AS dts, count(*) AS n FROM s GROUP BY ALL),
    d AS (SELECT *, dts - lag(dts) OVER (PARTITION BY track_id, type ORDER BY packet) AS delta FROM p)
    SELECT track_id, type, (coalesce(sum(delta), 0) + CASE WHEN type = 'audio' THEN (arg_max(n, packet) * 92160000 + 22050) // 44100 ELSE coalesce(floor(median(delta)), 0) END)::bigint AS duration
    FROM d GROUP BY track_id, type""")
def transport_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = containers.transport_times(views.samples(spark, sf_dir).drop("nal")).withColumn("packet", F.expr("case when type = 'audio' then idx div 4 else idx end"))
    return containers.transport_duration(rows, 44_100)


@query("track_fps_bitrate", f"""
    SELECT track_id, round(count(*)::double / any_value(duration) * 1000000, 9) AS fps, round((sum(size) * 1000000 * 8)::double / (any_value(duration) * 1000), 6) AS kbps
    FROM {SAMPLES} JOIN {DURATIONS} USING (track_id) GROUP BY track_id""")
def track_fps_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.samples(spark, sf_dir)
    sums = samples.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).join(transforms.durations(samples), "track_id")
    scale = F.lit(1_000_000).cast("long")
    return sums.select("track_id", F.round(containers.fps(F.col("n"), F.col("duration"), scale), 9).alias("fps"), F.round(containers.bitrate(F.col("bytes"), F.col("duration"), scale), 6).alias("kbps"))


@query("chunk_spans", f"""
    WITH c AS (SELECT track_id, gop, min(idx) AS first_idx, max(idx) AS last_idx, arg_min(pts, idx) AS start_pts, arg_max(pts, idx) AS last_pts FROM {GOPS} WHERE gop > 0 GROUP BY track_id, gop)
    SELECT *, lead(start_pts) OVER (PARTITION BY track_id ORDER BY gop) AS next_pts FROM c""")
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.chunk_spans(views.samples(spark, sf_dir), BLOCK)


@query("presentation_rank", f"SELECT track_id, idx, row_number() OVER (PARTITION BY track_id ORDER BY pts, idx) - 1 AS rank FROM {SAMPLES}")
def presentation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.presentation_rank(views.samples(spark, sf_dir)).select("track_id", "idx", "rank")


@query("zip_tracks", f"""
    WITH k AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS idx, pts FROM {SAMPLES} WHERE keyframe)
    SELECT s.track_id, s.idx, s.pts, k.pts AS key_pts FROM {SAMPLES} s JOIN k USING (track_id, idx)""")
def zip_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.samples(spark, sf_dir)
    return track.zipped(samples.select("track_id", "idx", "pts"), track.keep(samples, F.col("keyframe")), {"pts": "key_pts"})


@query("thumbnail_index", f"""
    WITH n AS (SELECT track_id, count(*) AS n FROM {SAMPLES} GROUP BY track_id), w AS (SELECT DISTINCT track_id, (i * (n - 1) * 2 + 7) // 14 AS idx FROM n, range(8) AS r(i))
    SELECT s.track_id, s.idx, s.pts FROM {SAMPLES} s JOIN w USING (track_id, idx)""")
def thumbnail_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.thumbnails(views.samples(spark, sf_dir), 8).select("track_id", "idx", "pts")


# ---------------------------------------------------------------- edit lists

@query("edit_box_valid", f"""
    WITH b AS (SELECT *, max(start_pts + duration_pts) OVER (PARTITION BY track_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM {EDIT_BOXES})
    SELECT track_id, bool_and(start_pts >= coalesce(e, 0)) AS valid FROM b GROUP BY track_id""")
def edit_box_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editboxes.as_array(views.edit_boxes(spark, sf_dir)).select("track_id", editboxes.valid(F.col("boxes")).alias("valid"))


REAL = f"""(
    SELECT s.track_id, s.idx, s.pts, coalesce(max(CASE WHEN pts >= start_pts AND pts < start_pts + duration_pts THEN ord * {DAY} + pts - start_pts END), -1)::bigint AS played,
        bool_or(pts = start_pts + duration_pts) AS at_end, min(CASE WHEN pts >= start_pts AND pts < start_pts + duration_pts THEN ord END) AS box,
        min(CASE WHEN pts = start_pts + duration_pts THEN ord END) AS ended
    FROM {SAMPLES} s JOIN {EDIT_BOXES} b USING (track_id) GROUP BY s.track_id, s.idx, s.pts)"""
REAL_PTS = f"(SELECT track_id, idx, pts, CASE WHEN ended < box THEN -1 ELSE played END AS real_pts FROM {REAL})"


@query("real_pts", f"SELECT * FROM {REAL_PTS}")
def real_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editboxes.with_real_pts(views.samples(spark, sf_dir), views.edit_boxes(spark, sf_dir)).select("track_id", "idx", "pts", "real_pts")


@query("plays_semi", f"SELECT track_id, idx FROM {REAL_PTS} WHERE real_pts >= 0")
def plays_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editboxes.played(views.samples(spark, sf_dir), views.edit_boxes(spark, sf_dir)).select("track_id", "idx")


@query("play_offsets", f"""
    SELECT track_id, ord, coalesce(sum(duration_pts) OVER (PARTITION BY track_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset" FROM {EDIT_BOXES}""")
def play_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editboxes.play_offsets(views.edit_boxes(spark, sf_dir)).select("track_id", "ord", "offset")


@query("frame_interval", f"""
    SELECT track_id, ord, min(idx) FILTER (pts >= start_pts) AS first_idx, max(idx) FILTER (pts < start_pts + duration_pts) AS last_idx
    FROM {SAMPLES} JOIN {EDIT_BOXES} b USING (track_id) GROUP BY track_id, ord""")
def frame_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editboxes.frame_interval(views.samples(spark, sf_dir), views.edit_boxes(spark, sf_dir))


#: A range that begins half a day into the second box and is two and a half days long.
START_MS, LENGTH_MS = 36 * 3_600_000, 60 * 3_600_000
TRIMMED = f"""(
    WITH c AS (SELECT *, (sum(duration_pts) OVER (PARTITION BY track_id ORDER BY ord) - duration_pts)::bigint AS before FROM {EDIT_BOXES}),
    o AS (SELECT track_id, ord, start_pts + greatest({START_MS}000 - before, 0) AS start_pts,
        least({START_MS + LENGTH_MS}000, before + duration_pts) - greatest({START_MS}000, before) AS duration_pts FROM c)
    SELECT track_id, (row_number() OVER (PARTITION BY track_id ORDER BY ord) - 1)::int AS ord, start_pts::bigint AS start_pts, duration_pts::bigint AS duration_pts FROM o WHERE duration_pts > 0)"""


@query("trim_edit_boxes", f"SELECT * FROM {TRIMMED}")
def trim_edit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = editboxes.as_array(views.edit_boxes(spark, sf_dir))
    cut = editboxes.trimmed(F.col("boxes"), F.lit(START_MS * 1000).cast("long"), F.lit(LENGTH_MS * 1000).cast("long"))
    return boxes.select("track_id", F.posexplode(cut).alias("ord", "b")).select("track_id", "ord", F.col("b.start").alias("start_pts"), F.col("b.duration").alias("duration_pts"))


@query("trim_track", f"""
    WITH e AS (SELECT track_id, min(start_pts) AS low, max(start_pts + duration_pts) AS high FROM {TRIMMED} GROUP BY track_id),
    s AS (SELECT s.*, low, high, min(idx) FILTER (pts >= low) OVER (PARTITION BY track_id) AS first, max(idx) FILTER (pts < high) OVER (PARTITION BY track_id) AS last FROM {SAMPLES} s JOIN e USING (track_id)),
    k AS (SELECT track_id, any_value(first) AS first, any_value(last) AS last, coalesce(max(idx) FILTER (keyframe AND idx <= first AND pts <= low), min(idx) FILTER (keyframe)) AS key FROM s GROUP BY track_id)
    SELECT s.track_id, s.idx - key AS idx, s.pts - b.dts AS pts, s.dts - b.dts AS dts, s.keyframe
    FROM s JOIN k USING (track_id) JOIN {SAMPLES} b ON b.track_id = s.track_id AND b.idx = key
    WHERE s.idx BETWEEN key AND k.last AND k.first >= key AND k.last >= k.first AND b.dts <= s.low AND k.last > key""")
def trim_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = transforms.trim(views.samples(spark, sf_dir), views.edit_boxes(spark, sf_dir), START_MS, LENGTH_MS)
    return rows.select("track_id", "idx", "pts", "dts", "keyframe")


# ---------------------------------------------------------------- whole-track transforms

@query("stitch_tracks", f"""
    WITH x AS (SELECT *, dts - lag(dts) OVER (PARTITION BY track_id, file_ord ORDER BY idx) AS delta FROM {CLIPS}),
    d AS (SELECT track_id, file_ord, max(dts) - min(dts) + coalesce(floor(median(delta)), 0)::bigint AS duration, arg_min(dts, idx) AS f FROM x GROUP BY track_id, file_ord),
    o AS (SELECT track_id, file_ord, (sum(duration) OVER (PARTITION BY track_id ORDER BY file_ord) - duration)::bigint - f AS moved FROM d)
    SELECT track_id, file_ord, row_number() OVER (PARTITION BY track_id ORDER BY file_ord, idx) - 1 AS idx, pts + moved AS pts, dts + moved AS dts FROM {CLIPS} JOIN o USING (track_id, file_ord)""")
def stitch_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.stitched(views.clips(spark, sf_dir)).select("track_id", "file_ord", "idx", "pts", "dts")


@query("remove_overlap", f"""
    WITH t AS (SELECT track_id, idx, dts // {HOUR} AS dts FROM {SAMPLES}),
    n AS (SELECT *, min(dts) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM t)
    SELECT track_id, idx, dts FROM n WHERE later IS NULL OR dts < later""")
def remove_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.without_overlap(views.coarse(spark, sf_dir), BLOCK).select("track_id", "idx", "dts")


@query("remove_overlap_fold", f"""
    WITH RECURSIVE r AS (SELECT track_id, idx, pts, dts, row_number() OVER (PARTITION BY track_id ORDER BY idx DESC) AS n FROM {SAMPLES}),
    k AS (
        SELECT track_id, n, pts AS p, dts AS d, true AS keep FROM r WHERE n = 1
        UNION ALL
        SELECT r.track_id, r.n, CASE WHEN pts < p AND dts < d THEN pts ELSE p END, CASE WHEN pts < p AND dts < d THEN dts ELSE d END, pts < p AND dts < d FROM k JOIN r ON r.track_id = k.track_id AND r.n = k.n + 1)
    SELECT track_id, idx, pts, dts FROM r JOIN k USING (track_id, n) WHERE keep""")
def remove_overlap_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.without_overlap_fold(views.samples(spark, sf_dir).select("track_id", "idx", "pts", "dts"))


@query("unique_pts_repair", f"""
    WITH RECURSIVE r AS (SELECT track_id, idx, dts // {HOUR} AS t, row_number() OVER (PARTITION BY track_id ORDER BY idx) AS n FROM {SAMPLES}),
    -- The sixteen largest values so far of either kind, and the least number by which both must be moved so that neither is taken.
    u AS (
        SELECT track_id, n, t AS pts, t AS dts, [t] AS sp, [t] AS sd FROM r WHERE n = 1
        UNION ALL
        SELECT track_id, n, t + j, t + j, list_append(CASE WHEN len(sp) >= 16 THEN list_filter(sp, lambda x: x <> list_min(sp)) ELSE sp END, t + j), list_append(CASE WHEN len(sd) >= 16 THEN list_filter(sd, lambda x: x <> list_min(sd)) ELSE sd END, t + j)
        FROM (SELECT r.track_id, r.n, t, sp, sd, list_filter(range(0, 64), lambda i: NOT list_contains(sp, t + i) AND NOT list_contains(sd, t + i))[1] AS j FROM u JOIN r ON r.track_id = u.track_id AND r.n = u.n + 1))
    SELECT track_id, idx, u.pts, u.dts FROM r JOIN u USING (track_id, n)""")
def unique_pts_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.unique_times(views.coarse(spark, sf_dir).select("track_id", "idx", "pts", "dts"))


@query("av_interleave", f"""
    WITH m AS (
        SELECT track_id, idx, type, max(dts::real / timescale::real) OVER (PARTITION BY track_id, type ORDER BY idx) AS t
        FROM {CROSSED} WHERE type IN ('audio', 'video')),
    p AS (SELECT track_id, idx, type, row_number() OVER (PARTITION BY track_id ORDER BY t, type <> 'video', idx) - 1 AS pos FROM m)
    SELECT *, row_number() OVER (PARTITION BY track_id, type ORDER BY pos) - 1 AS nth FROM p""")
def av_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.interleaved(views.crossed(spark, sf_dir)).select("track_id", "idx", "type", "pos", "nth")


@query("rescale_video", f"SELECT track_id, idx, (pts * 90000 + 500000) // 1000000 AS pts, (dts * 90000 + 500000) // 1000000 AS dts FROM {SAMPLES} WHERE type = 'video'")
def rescale_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = views.samples(spark, sf_dir).where("type = 'video'")
    return transforms.rescaled(video, F.lit(90_000).cast("long")).select("track_id", "idx", "pts", "dts")


@query("adts_packing", f"""
    WITH RECURSIVE r AS (SELECT track_id, idx, pts * 9 // 100 AS pts, dts * 9 // 100 AS dts, size, row_number() OVER (PARTITION BY track_id ORDER BY idx) AS n FROM {SAMPLES} WHERE type = 'audio'),
    k AS (
        SELECT track_id, n, 0::bigint AS packet, size + 7 AS used, 1::bigint AS frames, pts AS p, dts AS d FROM r WHERE n = 1
        UNION ALL
        SELECT track_id, n, packet + CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN fresh THEN 0 ELSE used END + size + 7, CASE WHEN fresh THEN 0 ELSE frames END + 1, CASE WHEN fresh THEN pts ELSE p END, CASE WHEN fresh THEN dts ELSE d END
        FROM (SELECT r.*, packet, used, frames, p, d, used + size + 7 > {20 * 184 - 19} OR abs(p + 90000 * frames * 1024 // 44100 - pts) > 10 OR abs(d + 90000 * frames * 1024 // 44100 - dts) > 10 AS fresh FROM k JOIN r ON r.track_id = k.track_id AND r.n = k.n + 1))
    SELECT track_id, idx, pts, dts, size, packet FROM r JOIN k USING (track_id, n)""")
def adts_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = containers.transport_times(views.samples(spark, sf_dir).where("type = 'audio'")).select("track_id", "idx", "pts", "dts", "size")
    return transforms.packed_adts(sound, 44_100)


@query("caption_asof_forward", f"""
    WITH v AS (SELECT * FROM {SAMPLES} WHERE type = 'video'), c AS (SELECT track_id, idx, pts FROM {SAMPLES} WHERE type = 'caption')
    SELECT v.track_id, v.idx, v.pts, arg_min(c.idx, (c.pts, c.idx)) AS caption_idx, min(c.pts) AS caption_pts
    FROM v LEFT JOIN c ON v.track_id = c.track_id AND c.pts >= v.pts GROUP BY v.track_id, v.idx, v.pts""")
def caption_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.samples(spark, sf_dir)
    return compare.captions_ahead(samples.where("type = 'video'"), samples.where("type = 'caption'"))


@query("open_gop", f"""
    WITH r AS (SELECT track_id, pts, dts, row_number() OVER (PARTITION BY track_id ORDER BY pts, dts, idx) - 1 AS idx FROM {SAMPLES})
    SELECT s.track_id, s.idx, keyframe AND (s.idx = 0 OR (r.pts = s.pts AND r.dts = s.dts)) AS keyframe FROM {SAMPLES} s JOIN r USING (track_id, idx)""")
def open_gop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.open_gops(views.samples(spark, sf_dir)).select("track_id", "idx", "keyframe")


@query("first_keyframe_trim", f"""
    WITH f AS (SELECT *, min(idx) FILTER (keyframe) OVER (PARTITION BY track_id) AS f FROM {SAMPLES})
    SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS idx, dts FROM f WHERE idx >= f""")
def first_keyframe_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.from_first_keyframe(views.samples(spark, sf_dir)).select("track_id", "idx", "dts")


@query("packet_interpolate", f"""
    WITH p AS (SELECT *, idx // 4 AS packet FROM {SAMPLES} WHERE type = 'audio'),
    k AS (SELECT *, row_number() OVER w - 1 AS k, first_value(pts) OVER w AS p0, first_value(dts) OVER w AS d0 FROM p WINDOW w AS (PARTITION BY track_id, packet ORDER BY idx))
    SELECT track_id, idx, packet, p0 + k * 92160000 // 44100 AS pts, d0 + k * 92160000 // 44100 AS dts FROM k""")
def packet_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = views.samples(spark, sf_dir).where("type = 'audio'").withColumn("packet", F.expr("idx div 4"))
    return containers.interpolated(sound, ["track_id", "packet"], 44_100).select("track_id", "idx", "packet", "pts", "dts")


@query("mux_timing", f"""
    SELECT track_id, idx, dts - first_value(dts) OVER w AS dts0, coalesce(lead(dts) OVER w - dts, nullif(dts - lag(dts) OVER w, 0), 1) AS length,
        coalesce(dts <= lag(dts) OVER w, false) AS broken FROM {SAMPLES} WINDOW w AS (PARTITION BY track_id ORDER BY idx)""")
def mux_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.written(views.samples(spark, sf_dir)).select("track_id", "idx", "dts0", "length", "broken")


@query("transport_times", f"SELECT track_id, idx, pts * 90000 // 1000000 AS pts, dts * 90000 // 1000000 AS dts FROM {SAMPLES}")
def transport_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.transport_times(views.samples(spark, sf_dir)).select("track_id", "idx", "pts", "dts")


@query("pcm_pack", f"""
    WITH c AS (SELECT *, sum(size) OVER (PARTITION BY track_id ORDER BY idx) AS cum, sum(size) OVER (PARTITION BY track_id) AS total FROM {SAMPLES} WHERE type = 'audio')
    SELECT track_id, idx, ((cum - 1) // 256)::bigint AS sound, size > 0 AND (cum - 1) // 256 <> (cum - size) // 256 AS straddles,
        (CASE WHEN cum = total THEN (256 - total % 256) % 256 ELSE 0 END)::bigint AS silence FROM c""")
def pcm_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.packed_sounds(views.samples(spark, sf_dir).where("type = 'audio'"), 256).select("track_id", "idx", "sound", "straddles", "silence")


@query("track_diff", f"""
    WITH a AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY dts, idx) - 1 AS pos, pts, size FROM {SAMPLES}),
    b AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY dts, idx) - 1 AS pos, pts, size FROM {SAMPLES} WHERE type <> 'data')
    SELECT track_id, pos, a.pts AS left_pts, b.pts AS right_pts FROM a FULL JOIN b USING (track_id, pos) WHERE a.pts IS DISTINCT FROM b.pts OR a.size IS DISTINCT FROM b.size""")
def track_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.samples(spark, sf_dir)
    found = compare.positional_diff(samples, samples.where("type <> 'data'"), ["pts", "size"], ["dts", "idx"])
    return found.select("track_id", "pos", F.col("a.pts").alias("left_pts"), F.col("b.pts").alias("right_pts"))


@query("validate_rules", f"""
    WITH s AS (SELECT *, keyframe AND type = 'video' AS key FROM {CROSSED} WHERE type IN ('video', 'audio')),
    g AS (
        SELECT *, sum(key::int) OVER (PARTITION BY track_id ORDER BY idx) AS gop, dts <= lag(dts) OVER w AS falls, pts <= lag(pts) OVER w AS pf
        FROM s WINDOW w AS (PARTITION BY track_id, type ORDER BY idx)),
    n AS (SELECT track_id, gop, count(*) FILTER (type = 'video') AS v FROM g GROUP BY ALL),
    l AS (SELECT track_id, max(v) FILTER (gop > 0) AS longest, coalesce(max(v) FILTER (gop = 0), 0) AS before FROM n GROUP BY track_id),
    t AS (
        SELECT track_id, count(*) FILTER (type = 'video') AS n_video, count(*) FILTER (type = 'audio') AS n_audio, coalesce(bool_or(falls) FILTER (type = 'video'), false) AS vf,
            coalesce(bool_or(falls) FILTER (type = 'audio'), false) AS af, coalesce(bool_or(pf) FILTER (type = 'audio'), false) AS ap FROM g GROUP BY track_id)
    SELECT track_id, n_video, n_audio, CASE WHEN n_video >= 16384 OR n_audio >= 16384 THEN 'too_many_samples' WHEN track_id % 5 = 0 THEN 'video_codec' WHEN n_audio > 0 AND track_id % 7 = 0 THEN 'audio_codec'
        WHEN n_video = 0 THEN 'no_video' WHEN before > 0 THEN 'no_first_keyframe' WHEN track_id % 11 = 0 THEN 'edit_boxes' WHEN vf THEN 'video_dts_order' WHEN af THEN 'audio_dts_order' WHEN ap THEN 'audio_pts_order'
        WHEN longest > 512 THEN 'gop_too_long' END AS error_category FROM t JOIN l USING (track_id)""")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, boxes = views.crossed(spark, sf_dir), views.edit_boxes(spark, sf_dir)
    tracks = boxes.select("track_id").distinct()
    settings = tracks.select("track_id", F.explode(F.array(F.lit("video"), F.lit("audio"))).alias("type")).withColumn(
        "codec", F.expr("case when type = 'video' then if(track_id % 5 = 0, 'vp8', 'h264') else if(track_id % 7 = 0, 'vorbis', 'aac_lc') end")
    )
    overlapping = boxes.withColumn("duration_pts", F.expr(f"if(track_id % 11 = 0, {4 * DAY}, duration_pts)"))
    return compare.validated(samples, settings, overlapping, BLOCK)
