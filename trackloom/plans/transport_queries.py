"""Queries over transport streams, written from the events' tracks and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import media, timed
from trackloom.functions.octets import big_endian
from trackloom.operators import editboxes, retiming, transforms
from trackloom.plans import track_queries
from trackloom.plans.catalog import query
from trackloom.sources import transport, views
from trackloom.sources.tables import materialise
from trackloom.sources.views import HOUR, SAMPLES

_hex = lambda c: F.lower(F.hex(c))
STEP, RATE = 3003, 48_000
#: Bytes that sound is cut at, whatever its frames.
CUT = 700

#: Pictures: a slice of 2 to 41 copies of the payload; parameter sets stand before every third keyframe only.
_V = f"""
    v AS (
        SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS idx, (pts - dts) // {HOUR} AS late, keyframe, keyframe AND event_id % 3 <> 1 AS sets, repeat(props, (2 + event_id * 7 % 40)::int) AS body
        FROM {SAMPLES} s JOIN (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, props, event_id FROM events) e USING (track_id, idx)
        WHERE type = 'video'),
    f AS (
        SELECT track_id, idx, 90000 + idx * {STEP} AS dts, 90000 + (idx + late) * {STEP} AS pts, keyframe, sets,
            '00000001' || CASE WHEN keyframe THEN '65' ELSE '41' END || lower(hex(encode(body))) AS slice,
            '0000000167' || lower(hex(encode('S' || idx % 2))) || '0000000168' || lower(hex(encode('P' || idx % 2))) AS own
        FROM v),
    p AS (SELECT *, last_value(CASE WHEN sets THEN own END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY idx) AS newest, CASE WHEN sets THEN own ELSE '' END || slice AS content FROM f)"""


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("nth", (F.row_number().over(Window.partitionBy("track_id").orderBy("idx")) - 1).cast("long"))


def events_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return numbered(views.samples(spark, sf_dir, "event_id").where(F.col("type") == kind))


def picture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, idx, pts, dts, keyframe, content): pictures as units behind start codes."""
    rows = events_of(spark, sf_dir, "video")
    mark = F.lit(b"\x00\x00\x00\x01")
    twice = (F.col("nth") % 2).cast("string")
    own = F.concat(mark, F.lit(b"\x67S"), F.encode(twice, "utf-8"), mark, F.lit(b"\x68P"), F.encode(twice, "utf-8"))
    body = F.encode(F.expr("repeat(decode(nal, 'utf-8'), cast(2 + event_id * 7 % 40 as int))"), "utf-8")
    slice_ = F.concat(mark, F.when(F.col("keyframe"), F.lit(b"\x65")).otherwise(F.lit(b"\x41")), body)
    content = F.concat(F.when(F.col("keyframe") & (F.col("event_id") % 3 != 1), own).otherwise(F.lit(b"")), slice_)
    time = lambda late: (90000 + (F.col("nth") + late) * STEP).cast("long")
    return rows.select(F.col("track_id").cast("string").alias("path"), F.col("nth").alias("idx"), time(F.expr(f"(pts - dts) div {HOUR}")).alias("pts"), time(F.lit(0)).alias("dts"), "keyframe", content.alias("content"))


_WAITS = f"""
    s AS (
        SELECT track_id, idx, pts, dts, keyframe, content, length(content) // 2 AS size, length(slice) // 2 - 4 AS unit, idx = max(idx) OVER (PARTITION BY track_id) AS last,
            14 + CASE WHEN pts <> dts THEN 5 ELSE 0 END + CASE WHEN keyframe THEN 8 ELSE 0 END + 6 + length(content) // 2 AS alone FROM p),
    w AS (
        SELECT track_id, idx, 0 AS held, CASE WHEN NOT last AND alone > 184 AND alone % 184 + 33 <= 184 AND unit >= alone % 184 THEN alone % 184 ELSE 0 END AS waits FROM s WHERE idx = 0
        UNION ALL
        SELECT s.track_id, s.idx, waits, CASE WHEN NOT last AND alone + waits > 184 AND (alone + waits) % 184 + 33 <= 184 AND unit >= (alone + waits) % 184 THEN (alone + waits) % 184 ELSE 0 END
        FROM w JOIN s ON s.track_id = w.track_id AND s.idx = w.idx + 1)"""


@query("transport_waits", f"WITH RECURSIVE {_V}, {_WAITS} SELECT track_id::varchar AS path, idx, held::int AS held, waits::int AS waits FROM w")
def transport_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.carries(picture_rows(spark, sf_dir)).select("path", "idx", "held", "waits")


@query("transport_packets", f"""
    WITH RECURSIVE {_V}, {_WAITS}
    SELECT track_id::varchar AS path, idx AS packet, pts, dts, keyframe AS random,
        coalesce(right(lag(content) OVER (PARTITION BY track_id ORDER BY idx), 2 * held), '') || '0000000109f0' || left(content, 2 * (size - waits)) AS data FROM s JOIN w USING (track_id, idx)""")
def transport_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.video_packets(picture_rows(spark, sf_dir)).select("path", "packet", "pts", "dts", "random", _hex(F.col("data")).alias("data"))


#: What is read back: a keyframe's parameter sets are the newest ones; without any it is Invalid.
_PICTURES = """
    SELECT track_id::varchar AS path, 'video' AS type, idx, pts, dts, keyframe, CASE WHEN keyframe THEN newest || slice ELSE slice END AS content,
        CASE WHEN keyframe AND newest IS NULL THEN 'Invalid' END AS error FROM p"""


def video_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = transport.video_packets(picture_rows(spark, sf_dir))
    return packets.withColumn("pid", F.lit(transport.PIDS["video"]))


@query("transport_pictures", f"WITH {_V} {_PICTURES}")
def transport_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transport.pictures(video_streams(spark, sf_dir))
    return found.select("path", F.lit("video").alias("type"), "idx", "pts", "dts", "keyframe", _hex(F.col("content")).alias("content"), "error")


# ---------------------------------------------------------------- sound

_S = f"""
    a AS (
        SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS idx, repeat(props, (1 + event_id * 5 % 12)::int) AS body
        FROM {SAMPLES} s JOIN (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, props, event_id FROM events) e USING (track_id, idx)
        WHERE type = 'audio'),
    g AS (
        SELECT track_id, idx, lower(hex(encode(body))) AS content, strlen(body) + 7 AS size, coalesce(sum(strlen(body) + 7) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS begin
        FROM a)"""


def sound_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_of(spark, sf_dir, "audio")
    body = F.encode(F.expr("repeat(decode(nal, 'utf-8'), cast(1 + event_id * 5 % 12 as int))"), "utf-8")
    return rows.select("track_id", F.col("track_id").cast("string").alias("path"), F.col("nth").alias("idx"), body.alias("content"))


@query("transport_sounds", f"""
    WITH {_S}, k AS (SELECT *, begin // {CUT} AS packet, row_number() OVER (PARTITION BY track_id, begin // {CUT} ORDER BY idx) - 1 AS nth FROM g)
    SELECT track_id::varchar AS path, idx, packet, 90000 + packet * 5000 + nth * {90000 * 1024} // {RATE} AS pts, 90000 + packet * 5000 + nth * {90000 * 1024} // {RATE} AS dts,
        'aac_lc' AS codec, {RATE} AS sample_rate, 2::int AS channels, content, NULL::varchar AS error FROM k""")
def transport_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound cut into packets of fixed size wherever its frames end."""
    rows = sound_rows(spark, sf_dir)
    framed = rows.withColumn("piece", F.concat(media.adts_header(F.octet_length("content"), RATE, 2), "content"))
    whole = framed.groupBy("path").agg(F.expr("listagg(piece) within group (order by idx)").alias("all"))
    cuts = F.transform(F.sequence(F.lit(0), F.expr(f"cast((octet_length(all) - 1) div {CUT} as int)")), lambda i: F.substring("all", i * CUT + 1, F.lit(CUT)))
    packets = whole.select("path", F.posexplode(cuts).alias("packet", "data")).withColumns({"packet": F.col("packet").cast("long"), "pid": F.lit(transport.PIDS["audio"])})
    time = 90000 + F.col("packet") * 5000
    found = transport.sounds(packets.withColumns({"pts": time, "dts": time}))
    return found.select("path", "idx", "packet", "pts", "dts", "codec", "sample_rate", "channels", _hex(F.col("content")).alias("content"), "error")


# ---------------------------------------------------------------- cells

def packed_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound in the packets that its times and sizes allow: every sixteenth frame is late, so that a packet ends there."""
    rows = sound_rows(spark, sf_dir)
    time = F.expr(f"90000 + idx * {90000 * 1024} div {RATE} + idx div 16 * 2000")
    rows = rows.withColumns({"pts": time, "dts": time, "size": F.octet_length("content")})
    return transport.audio_packets(transforms.packed_adts(rows, RATE), RATE, 2)


def streams_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.video_packets(picture_rows(spark, sf_dir)).unionByName(packed_sounds(spark, sf_dir))


@query("transport_cells", f"""
    WITH RECURSIVE {_V}, {_WAITS},
    d AS (
        SELECT track_id, idx, pts, dts, keyframe, coalesce(right(lag(content) OVER (PARTITION BY track_id ORDER BY idx), 2 * held), '') || '0000000109f0' || left(content, 2 * (size - waits)) AS data FROM s JOIN w USING (track_id, idx)),
    t AS (
        SELECT *, printf('%02x%04x%04x', (m * 16 + (pts >> 30 & 7) * 2 + 1), (pts >> 15 & 32767) * 2 + 1, (pts & 32767) * 2 + 1) AS one, printf('%02x%04x%04x', 16 + (dts >> 30 & 7) * 2 + 1, (dts >> 15 & 32767) * 2 + 1, (dts & 32767) * 2 + 1) AS two
        FROM (SELECT *, CASE WHEN pts <> dts THEN 3 ELSE 2 END AS m FROM d)),
    b AS (
        SELECT track_id, idx, dts, keyframe, CASE WHEN keyframe THEN 176 ELSE 184 END AS first,
            '000001e0' || printf('%04x', CASE WHEN n > 65535 THEN 0 ELSE n END) || CASE WHEN m = 3 THEN '80c00a' || one || two ELSE '808005' || one END || data AS whole
        FROM (SELECT *, length(data) // 2 + CASE WHEN m = 3 THEN 13 ELSE 8 END AS n FROM t)),
    c AS (SELECT *, length(whole) // 2 AS size, 1 + greatest(ceil((length(whole) // 2 - first) / 184.0), 0)::bigint AS cells FROM b),
    e AS (SELECT *, coalesce(sum(cells) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS begin FROM c),
    x AS (SELECT *, unnest(range(cells)) AS j FROM e),
    y AS (SELECT *, CASE WHEN j = 0 THEN 0 ELSE first + (j - 1) * 184 END AS pos, CASE WHEN j = 0 THEN first ELSE 184 END AS room FROM x),
    z AS (SELECT *, least(room, size - pos) AS taken, room - least(room, size - pos) AS free FROM y)
    SELECT track_id::varchar AS path, begin + j + 2 AS n, 256::int AS pid,
        '47' || printf('%04x', 256 + CASE WHEN j = 0 THEN 16384 ELSE 0 END) || printf('%02x', (begin + j) % 16 + CASE WHEN free > 0 OR (keyframe AND j = 0) THEN 48 ELSE 16 END)
        || CASE WHEN keyframe AND j = 0 THEN printf('%02x50%08x%04x', free + 7, dts >> 1, (dts & 1) * 32768 + 32256) || repeat('ff', free::int) WHEN free = 1 THEN '00' WHEN free > 1 THEN printf('%02x00', free - 1) || repeat('ff', (free - 2)::int) ELSE '' END
        || substr(whole, (2 * pos + 1)::int, (2 * taken)::int) AS cell
    FROM z""")
def transport_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transport.packet_cells(transport.video_packets(picture_rows(spark, sf_dir)), ["dts", "kind"])
    return rows.where(F.col("pid") == transport.PIDS["video"]).select("path", "n", "pid", _hex(F.col("cell")).alias("cell"))


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): files of pictures and sound, written as a table, as what reads them looks for their programs, their streams and their packets."""
    return materialise(transport.as_files(transport.packet_cells(streams_of(spark, sf_dir), ["dts", F.desc("kind"), "packet"])), "streams")


@query("transport_round_trip", f"""
    WITH {_V}, {_S} {_PICTURES}
    UNION ALL
    SELECT track_id::varchar, 'audio', idx, 90000 + idx * {90000 * 1024} // {RATE} + idx // 16 * 2000 AS pts, 90000 + idx * {90000 * 1024} // {RATE} + idx // 16 * 2000, true, content, NULL FROM g""")
def transport_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures and sound written into files of cells and read back."""
    made = files_of(spark, sf_dir)
    return transport.read(made).select("path", "type", "idx", "pts", "dts", "keyframe", _hex(F.col("content")).alias("content"), "error")


@query("transport_streams", """
    SELECT user_id::varchar AS path, CASE WHEN event_type = 'click' THEN 257 ELSE 256 END::int AS pid, CASE WHEN event_type = 'click' THEN 'audio' ELSE 'video' END AS kind
    FROM events WHERE event_type IN ('view', 'signup', 'click') GROUP BY ALL""")
def transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams that written files name."""
    made = files_of(spark, sf_dir)
    return transport.streams(transport.cells(made)).select("path", "pid", "kind")


# ---------------------------------------------------------------- timed metadata

@query("timed_info", """
    WITH e AS (SELECT event_id, event_id % 8 AS k, round(value, 2) AS v, props FROM events),
    f AS (SELECT *, CASE WHEN k = 5 THEN 'Unsupported' WHEN k IN (6, 7) THEN 'Invalid' END AS error FROM e)
    SELECT event_id, CASE WHEN error IS NULL AND k NOT IN (1, 4) THEN (event_id % 1000 + 0.25)::double END AS clock, CASE WHEN error IS NULL AND k NOT IN (2, 4) THEN (((event_id * 45) % 360 + 45) // 90 % 4)::int END AS orientation, error FROM f""")
def timed_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data samples with a clock and an orientation, one of them, none, an older clock before, or faulty ones."""
    rows = views.table(spark, sf_dir, "events").select("event_id", "props")
    k = F.col("event_id") % 8

    def frame(name: str, text: Column, encoding: Column | None = None, more: int = 0) -> Column:
        body = F.concat(encoding if encoding is not None else F.lit(b"\x03"), F.encode(text, "utf-8"), F.lit(b"\x00"))
        return F.concat(F.lit(name.encode()), big_endian((F.octet_length(body) + more).cast("long")), F.lit(b"\x00\x00"), body)

    clock, turn = F.concat((F.col("event_id") % 1000).cast("string"), F.lit(".25")), (F.col("event_id") * 45).cast("string")
    empty, before = F.lit(b""), F.concat(F.lit(b"ID3\x04\x00"), F.encode("props", "utf-8"))
    content = F.concat(
        before, F.when(k == 3, frame("TIT3", F.lit("7 TKEY"))).otherwise(empty),
        F.when(k.isin(1, 4), empty).when(k == 5, frame("TIT3", clock, F.lit(b"\x01"))).when(k == 6, frame("TIT3", F.concat(F.lit("-"), clock))).otherwise(frame("TIT3", clock)), F.encode("props", "utf-8"),
        F.when(k.isin(2, 4), empty).when(k == 7, frame("TKEY", turn, more=50)).otherwise(frame("TKEY", turn)),
    )
    return rows.select("event_id", timed.timed_info(content).alias("i")).select("event_id", "i.clock", "i.orientation", "i.error")


# ---------------------------------------------------------------- pictures encoded anew

#: Every second played time gets a picture of the encoder; every fifth track has a picture too many.
_AGAIN = f"""
    t AS (SELECT track_id, real_pts, row_number() OVER (PARTITION BY track_id ORDER BY real_pts, idx) - 1 AS rank, min(real_pts) OVER (PARTITION BY track_id) AS first, count(*) OVER (PARTITION BY track_id) AS n FROM {track_queries.REAL_PTS} JOIN (SELECT track_id, idx, type FROM {SAMPLES}) USING (track_id, idx) WHERE real_pts >= 0 AND type = 'video'),
    v AS (SELECT track_id, rank // 2 AS idx, real_pts - first AS pts, first FROM t WHERE rank % 2 = 0 AND track_id % 5 <> 0)"""


def encoded_again(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    real = editboxes.with_real_pts(views.samples(spark, sf_dir).where("type = 'video'").drop("nal"), views.edit_boxes(spark, sf_dir))
    counts = real.where("real_pts >= 0").groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    many = F.expr("(n + 1) div 2 + if(track_id % 5 = 0, 1, 0)")
    frames = counts.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("idx"))
    return frames.withColumns({"keyframe": F.col("idx") % 30 == 0, "timescale": F.lit(1_000_000).cast("long")}), real


@query("retimed_pictures", f"WITH {_AGAIN} SELECT track_id, idx, pts, pts AS dts, idx % 30 = 0 AS keyframe FROM v")
def retimed_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retiming.retimed(*encoded_again(spark, sf_dir), 2)[0].select("track_id", "idx", "pts", "dts", "keyframe")


@query("retimed_sound", f"""
    WITH {_AGAIN}, l AS (SELECT track_id, (max(pts)::real / 1000000::real)::real AS last, any_value(first) AS first FROM v GROUP BY track_id),
    a AS (
        SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY s.idx) - 1 AS idx, dts, pts - min(dts) OVER (PARTITION BY track_id) AS pts FROM {SAMPLES} s JOIN l USING (track_id)
        WHERE type = 'audio' AND (dts::real / 1000000::real)::real < last AND dts >= first)
    SELECT track_id, idx, dts - min(dts) OVER (PARTITION BY track_id) AS dts, pts, min(dts) OVER (PARTITION BY track_id) AS audio_first FROM a""")
def retimed_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures, tracks = retiming.retimed(*encoded_again(spark, sf_dir), 2)
    sound = views.samples(spark, sf_dir).where("type = 'audio'").drop("nal")
    return retiming.sound_within(sound, pictures, tracks).select("track_id", "idx", "pts", "dts", "audio_first")


@query("retimed_boxes", f"""
    SELECT track_id, ord, start_pts + CASE WHEN ord = 0 THEN 5 * track_id ELSE 0 END - 7 * track_id AS start_pts, duration_pts - CASE WHEN ord = 0 THEN 5 * track_id ELSE 0 END AS duration_pts FROM {views.EDIT_BOXES}""")
def retimed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = views.edit_boxes(spark, sf_dir)
    firsts = boxes.select("track_id").distinct().selectExpr("track_id", "7 * track_id as audio_first", "5 * track_id as offset")
    return retiming.boxes_within(boxes, firsts).select("track_id", "ord", "start_pts", "duration_pts")
