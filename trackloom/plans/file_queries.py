"""Queries over whole MP4 files, their forms and fragments, and over captions in pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.octets import big_endian
from trackloom.operators import captions
from trackloom.plans.catalog import query
from trackloom.sources import exif, mp4, views
from trackloom.sources.tables import materialise
from trackloom.sources.views import SAMPLES

_hex = lambda c: F.lower(F.hex(c))


# ---------------------------------------------------------------- forms of files

#: Sound and pictures in thousandths of a second, each with its own numbers; sound is all keyframes.
_M = f"""
    m AS (
        SELECT track_id, type, row_number() OVER (PARTITION BY track_id, type ORDER BY idx) - 1 AS idx, pts // 1000 AS pts, dts // 1000 AS dts, size::bigint AS size, keyframe OR type = 'audio' AS keyframe, lower(hex(encode(props))) AS content
        FROM {SAMPLES} s JOIN (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, props FROM events) e USING (track_id, idx)
        WHERE type IN ('video', 'audio')),
    o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY (dts::real / 1000::real)::real, type = 'audio', idx) - 1 AS pos, dts - first_value(dts) OVER (PARTITION BY track_id, type ORDER BY idx) AS time FROM m),
    a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY track_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS ahead, pos - idx AS run FROM o),
    c AS (SELECT *, (row_number() OVER (PARTITION BY track_id, type, run ORDER BY pos) - 1) // 10 AS part, (row_number() OVER (PARTITION BY track_id, type, run ORDER BY pos) - 1) % 10 = 0 AS starts FROM a),
    n AS (SELECT *, count(*) OVER (PARTITION BY track_id, type, run, part) AS n FROM c),
    r AS (SELECT *, starts AND n IS DISTINCT FROM lag(n) OVER (PARTITION BY track_id, type, starts ORDER BY idx) AS changes FROM n),
    t AS (
        SELECT track_id, type, count(*) AS samples, count(*) FILTER (starts) AS chunks, count(*) FILTER (changes) AS runs, count(*) FILTER (keyframe) AS keys, sum(size) AS bytes FROM r GROUP BY ALL),
    h AS (
        SELECT *, 8 + 92 + 8 + 32 + 33 + 8 + 8 + 16 + 16 + 8 * samples + 16 + 8 * samples + CASE WHEN keys < samples THEN 16 + 4 * keys ELSE 0 END + 20 + 4 * samples + 16 + 12 * runs + 16 + 4 * chunks AS trak,
            8 + 16 + 20 + 20 * chunks + 16 * samples AS traf FROM t),
    z AS (SELECT track_id, sum(bytes) AS bytes, 16 + 8 + 108 + sum(trak) + 8 AS head, 8 + 16 + sum(traf) + 8 AS moof, count(*) AS tracks FROM h GROUP BY track_id)"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir).where("type in ('video', 'audio')")
    rows = rows.withColumn("idx", (F.row_number().over(Window.partitionBy("track_id", "type").orderBy("idx")) - 1).cast("long"))
    return rows.selectExpr("track_id", "type", "idx", "pts div 1000 as pts", "dts div 1000 as dts", "1000L as timescale", "keyframe or type = 'audio' as keyframe", "cast(size as long) as size", "nal as content")


@query("mp4_whole", f"WITH {_M} SELECT track_id, type, idx, pts, time AS dts, keyframe, (head + ahead)::bigint AS pos, size, content FROM r JOIN z USING (track_id)")
def mp4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with sound and pictures, written and read back, with the bytes that stand where the tables say."""
    files = materialise(mp4.whole(media(spark, sf_dir)), "mp4").withColumnRenamed("track_id", "file")
    rows = mp4.sample_tables(files, "file").drop("trak", "timescale").join(files, "file")
    return rows.select(F.col("file").alias("track_id"), "type", "idx", "pts", "dts", "keyframe", "pos", "size", _hex(F.substring("content", (F.col("pos") + 1).cast("int"), F.col("size").cast("int"))).alias("content"))


@query("mp4_fragments", f"WITH {_M} SELECT track_id, type, idx, pts, dts, keyframe, (moof + ahead)::bigint AS pos, size, content FROM r JOIN z USING (track_id)")
def mp4_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = materialise(mp4.whole(media(spark, sf_dir), "dash_data"), "mp4").withColumnRenamed("track_id", "file")
    rows = mp4.fragments(files, "file").join(files, "file")
    return rows.select(F.col("file").alias("track_id"), "type", "idx", "pts", "dts", "keyframe", "pos", "size", _hex(F.substring("content", (F.col("pos") + 1).cast("int"), F.col("size").cast("int"))).alias("content"))


@query("mp4_forms", f"""
    WITH {_M}, s AS (SELECT track_id, string_agg(content, '' ORDER BY pos) AS payload FROM r GROUP BY track_id)
    SELECT track_id, (head + bytes)::int AS regular, head::int AS header, bytes::int AS samples, (moof + bytes)::int AS dash_data, (16 + 8 + 108 + tracks * (8 + 92 + 8 + 32 + 33 + 8 + 8 + 16 + 16 + 16 + 20 + 16 + 16) + 8 + 64)::int AS dash_init,
        payload, true AS parts FROM z JOIN s USING (track_id)""")
def mp4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of all forms, the payloads, and whether a regular file is its header and samples."""
    rows = materialise(media(spark, sf_dir), "media")
    joined = None
    for form in mp4.FORMS:
        one = mp4.whole(rows, form).withColumnRenamed("content", form)
        joined = one if joined is None else joined.join(one, "track_id")
    parts = F.col("regular") == F.concat("header", "samples")
    return joined.select("track_id", *[F.octet_length(f).alias(f) for f in mp4.FORMS], _hex(F.col("samples")).alias("payload"), parts.alias("parts"))


# ---------------------------------------------------------------- captions

#: Pictures with message units: with a caption beside another message, with another message only, with two units of which the second has captions, and none.
_C = f"""
    v AS (
        SELECT track_id, idx, pts, dts, keyframe, idx % 4 AS k, lower(hex(encode(props))) AS p, strlen(props) AS n
        FROM {SAMPLES} s JOIN (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, props FROM events) e USING (track_id, idx) WHERE type = 'video'),
    m AS (SELECT *, printf('04%02x', n) || p AS cap, printf('05%02x', n) || p AS other, printf('%08x', n + 1) || CASE WHEN keyframe THEN '65' ELSE '41' END || p AS slice FROM v),
    u AS (
        SELECT *, CASE k WHEN 0 THEN printf('%08x', 2 * (n + 2) + 2) || '06' || other || cap || '80' WHEN 1 THEN printf('%08x', n + 4) || '06' || other || '80' WHEN 2 THEN printf('%08x', n + 4) || '06' || other || '80' ELSE '' END AS before,
            CASE k WHEN 2 THEN printf('%08x', 2 * (n + 2) + 2) || '06' || cap || cap || '80' ELSE '' END AS after FROM m)"""


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir).where("type = 'video'")
    n = F.octet_length("nal")

    def message(kind: int) -> Column:
        return F.concat(F.lit(bytes([kind])), big_endian(n, 1), "nal")

    def unit(*parts: Column) -> Column:
        body = F.concat(*parts)
        return F.concat(big_endian(F.octet_length(body)), body)

    sei = lambda *m: unit(F.lit(b"\x06"), *m, F.lit(b"\x80"))
    slice_, k = unit(F.when(F.col("keyframe"), F.lit(b"\x65")).otherwise(F.lit(b"\x41")), F.col("nal")), F.col("idx") % 4
    content = F.when(k == 0, F.concat(sei(message(5), message(4)), slice_)).when(k == 1, F.concat(sei(message(5)), slice_)).when(k == 2, F.concat(sei(message(5)), slice_, sei(message(4), message(4)))).otherwise(slice_)
    return rows.withColumn("content", content).drop("nal")


@query("caption_tracks", f"""
    WITH {_C}, w AS (
        SELECT *, CASE WHEN k IN (0, 2) THEN slice ELSE before || slice END AS picture,
            CASE k WHEN 0 THEN printf('%08x', n + 4) || '06' || cap || '80' WHEN 2 THEN after ELSE '' END AS caption FROM u)
    SELECT track_id, idx, pts, dts, keyframe, 'video' AS type, (length(picture) // 2)::int AS size, picture AS content FROM w
    UNION ALL SELECT track_id, idx, pts, dts, keyframe, 'caption', (length(caption) // 2)::int, caption FROM w""")
def caption_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captions.tracks(captioned(spark, sf_dir))
    return found.select("track_id", "idx", "pts", "dts", "keyframe", "type", "size", _hex(F.col("content")).alias("content"))


# ---------------------------------------------------------------- image metadata

_WORDS = ("make", "model", "software", "modify_date", "latitude_ref", "longitude_ref", "speed_ref", "direction_ref", "bearing_ref", "date_stamp")
_RATIOS = ("x_resolution", "y_resolution", "exposure_time", "altitude", "speed", "direction", "bearing")
_THREES = ("latitude", "longitude", "time_stamp")


def _words(name: str) -> str:
    return f"coalesce(source, '') || ' {name} ' || repeat('{name[0]}', (doc_id % 7)::int)"


#: Where a value is missing by a rule of the row: every fifth has no places, every seventh a bad orientation, every tenth is cut off.
_EXIF = ", ".join(
    [f"CASE WHEN cut OR (gps AND {str(n in _WORDS[4:]).lower()}) THEN NULL ELSE {_words(n)} END AS {n}" for n in _WORDS]
    + [f"CASE WHEN cut OR (gps AND {str(n in _RATIOS[3:]).lower()}) OR (doc_id + {k}) % 6 = 0 THEN NULL ELSE (doc_id + {k}) || '/' || (doc_id + {k}) % 6 END AS {n}" for k, n in enumerate(_RATIOS)]
    + [f"CASE WHEN cut OR gps THEN NULL ELSE doc_id || '/1 ' || doc_id % 60 || '/{k + 1} ' || n_chars || '/100' END AS {n}" for k, n in enumerate(_THREES)]
    + ["CASE WHEN cut OR doc_id % 9 NOT BETWEEN 1 AND 8 THEN 1 ELSE doc_id % 9 END::int AS orientation", "CASE WHEN cut OR doc_id % 5 NOT BETWEEN 1 AND 3 THEN NULL ELSE doc_id % 5 END::int AS resolution_unit", "CASE WHEN cut OR gps OR doc_id % 4 > 1 THEN NULL ELSE doc_id % 4 END::int AS altitude_ref"]
)


@query("exif_round_trip", f"SELECT doc_id, {_EXIF} FROM (SELECT *, doc_id % 5 = 4 AS gps, doc_id % 10 = 9 AS cut FROM documents)")
def exif_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tags written for every document and read back; some blocks without places, some values out of range, some blocks cut off."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    i, gps = F.col("doc_id"), F.col("doc_id") % 5 == 4
    ratio = lambda a, b: F.struct(a.cast("long").alias("numerator"), b.cast("long").alias("denominator"))
    word = lambda n: F.concat(F.coalesce("source", F.lit("")), F.lit(f" {n} "), F.expr(f"repeat('{n[0]}', cast(doc_id % 7 as int))"))
    values = {n: F.when(~gps, word(n)) if n in _WORDS[4:] else word(n) for n in _WORDS}
    values |= {n: F.when(~gps | F.lit(n not in _RATIOS[3:]), ratio(i + k, (i + k) % 6)) for k, n in enumerate(_RATIOS)}
    values |= {n: F.when(~gps, F.array(ratio(i, F.lit(1)), ratio(i % 60, F.lit(k + 1)), ratio(F.col("n_chars"), F.lit(100)))) for k, n in enumerate(_THREES)}
    values |= {"orientation": (i % 9).cast("int"), "resolution_unit": (i % 5).cast("int"), "altitude_ref": F.when(~gps, (i % 4).cast("int"))}
    made = exif.written(docs.withColumns(values), "block").select("doc_id", "block")
    made = made.withColumn("block", F.when(i % 10 == 9, F.substring("block", 1, 15)).otherwise(F.col("block")))
    found = exif.read(made, "block", {"orientation": 1})
    shown = lambda r: F.concat_ws("/", r["numerator"], r["denominator"])
    texts = {n: F.when(F.col(n).isNotNull(), shown(F.col(n))) for n in _RATIOS} | {n: F.when(F.col(n).isNotNull(), F.array_join(F.transform(n, shown), " ")) for n in _THREES}
    return found.withColumns(texts).select("doc_id", *_WORDS, *_RATIOS, *_THREES, "orientation", "resolution_unit", "altitude_ref")
