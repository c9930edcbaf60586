"""Queries over headers, payloads, sizes and colours that no track query uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import arith, colour, media, octets
from trackloom.operators import containers, images
from trackloom.plans.catalog import query
from trackloom.plans.image_queries import PIXELS, pixels
from trackloom.sources import readers, views
from trackloom.sources.views import FRAMES, SAMPLES, table

_hex = lambda c: F.lower(F.hex(c))


def octet(n: Column, size: int = 1) -> Column:
    return octets.big_endian(n, size)


# ---------------------------------------------------------------- payloads

#: A payload of parameter sets before a keyframe, and one slice otherwise; every eleventh keyframe lacks them.
NALS = f"""(
    SELECT track_id, idx, keyframe, idx % 11 <> 0 AS sets, lower(hex(encode(type))) AS body, length(type) AS n FROM {SAMPLES})"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir)
    mark, kind = F.unhex(F.lit("00000001")), lambda n: F.concat(octet(F.lit(n)), F.encode("type", "utf-8"))
    slice_ = F.concat(F.unhex(F.lit("000001")), F.when(F.col("keyframe"), octet(F.lit(0x65))).otherwise(octet(F.lit(0x41))), F.encode("type", "utf-8"))
    sets = F.when(F.col("keyframe") & (F.col("idx") % 11 != 0), F.concat(mark, kind(0x67), mark, kind(0x68))).otherwise(F.unhex(F.lit("")))
    return rows.select("track_id", "idx", F.concat(sets, slice_).alias("payload"))


@query("nal_facts", f"SELECT track_id, idx, keyframe AND sets AS parameters, keyframe AS picture, (CASE WHEN keyframe AND sets THEN 3 ELSE 1 END)::int AS units, (CASE WHEN keyframe AND sets THEN 7 WHEN keyframe THEN 5 ELSE 1 END)::int AS first_type FROM {NALS}")
def nal_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads(spark, sf_dir).withColumn("units", octets.nal_units(F.col("payload")))
    units = F.col("units")
    return rows.select("track_id", "idx", octets.parameter_sets(units).alias("parameters"), octets.has_type(units, 5).alias("picture"), F.size("units").alias("units"), units[0]["type"].alias("first_type"))


@query("nal_convert", f"""
    SELECT track_id, idx, CASE WHEN keyframe AND sets THEN printf('%08x', n + 1) || '67' || body || printf('%08x', n + 1) || '68' || body ELSE '' END || printf('%08x', n + 1) || CASE WHEN keyframe THEN '65' ELSE '41' END || body AS avcc,
        CASE WHEN keyframe AND sets THEN '0000000167' || body || '0000000168' || body ELSE '' END || '00000001' || CASE WHEN keyframe THEN '65' ELSE '41' END || body AS annexb FROM {NALS}""")
def nal_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    avcc = octets.convert_nals(F.col("payload"), "avcc")
    rows = payloads(spark, sf_dir).withColumn("avcc", avcc)
    return rows.select("track_id", "idx", _hex(F.col("avcc")).alias("avcc"), _hex(octets.convert_nals(F.col("avcc"), "annexb")).alias("annexb"))


@query("annexb_units", f"""
    WITH p AS (SELECT track_id, idx, nal, strlen(nal) AS n FROM (SELECT s.track_id, s.idx, e.props AS nal FROM {SAMPLES} s JOIN (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, props FROM events) e USING (track_id, idx))),
    t AS (SELECT *, ascii(nal) & 31 AS k FROM p),
    u AS (SELECT track_id, idx, CASE WHEN k IN (1, 5, 6, 7, 8, 9, 10, 11, 12) THEN k ELSE 255 END::int AS type, n FROM t)
    SELECT track_id, idx, type, 4::int AS byte_offset, n::int AS size, 4::int AS prefix FROM u UNION ALL SELECT track_id, idx, type, (n + 7)::int, n::int, 3::int FROM u""")
def annexb_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.concat(F.unhex(F.lit("00000001")), F.col("nal"), F.unhex(F.lit("000001")), F.col("nal"))
    rows = views.samples(spark, sf_dir).select("track_id", "idx", payload.alias("payload"))
    return rows.select("track_id", "idx", F.explode(octets.nal_units(F.col("payload"))).alias("u")).select("track_id", "idx", "u.*")


@query("caption_units", f"""
    SELECT track_id, idx, CASE WHEN type = 'caption' THEN printf('%08x', n + 4) || '06' || '04' || printf('%02x', n) || body || '80' ELSE '' END AS caption
    FROM (SELECT track_id, idx, type, length(type) + idx % 5 AS n, lower(hex(encode(type))) || repeat('61', (idx % 5)::int) AS body FROM {SAMPLES})""")
def caption_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir)
    body = F.encode(F.concat("type", F.repeat(F.lit("a"), (F.col("idx") % 5).cast("int"))), "utf-8")
    message = lambda kind: F.concat(octet(kind), octet(F.octet_length(body)), body)
    kind = F.when(F.col("type") == "caption", 4).otherwise(5)
    unit = F.concat(F.unhex(F.lit("06")), message(F.lit(1)), message(kind), F.unhex(F.lit("80")))
    return rows.select("track_id", "idx", _hex(octets.captions(unit)).alias("caption"))


@query("extradata", """
    SELECT doc_id, printf('%04x', strlen(source)) || lower(hex(encode(source))) || printf('%04x', strlen(lang)) || lower(hex(encode(lang))) AS iso,
        '00000001' || lower(hex(encode(source))) || '00000001' || lower(hex(encode(lang))) AS annex_b, printf('%08x', strlen(source)) || lower(hex(encode(source))) || printf('%08x', strlen(lang)) || lower(hex(encode(lang))) AS avcc
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def extradata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    sps, pps = F.encode("source", "utf-8"), F.encode("lang", "utf-8")
    return rows.select("doc_id", *[_hex(octets.extradata(sps, pps, form=f)).alias(f) for f in ("iso", "annex_b", "avcc")])


#: Every eleventh configuration has one of these faults: version, length size, number of sets, an empty set, a byte too many, an extension, cut off.
@query("avc_config", """
    WITH d AS (SELECT *, CASE WHEN doc_id % 11 > 7 OR coalesce(lang, '') = '' THEN -1 ELSE doc_id % 11 END AS fault, coalesce(source, '') AS s, coalesce(lang, '') AS l FROM documents),
    e AS (SELECT *, CASE WHEN fault = 7 OR fault = 0 THEN 'Invalid' WHEN fault = 1 OR (fault <> 0 AND doc_id % 4 IN (0, 2)) THEN 'Unsupported' WHEN s = '' OR fault = 2 THEN 'Invalid' WHEN fault = 3 THEN 'Unsupported' WHEN l = '' OR fault = 4 THEN 'Invalid' WHEN fault = 5 THEN 'Unsupported' END AS error FROM d)
    SELECT doc_id, CASE WHEN error IS NULL THEN (doc_id % 4 + 1)::int END AS length_size, CASE WHEN error IS NULL THEN s END AS sps, CASE WHEN error IS NULL THEN l END AS pps, error FROM e""")
def avc_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", *[F.encode(F.coalesce(c, F.lit("")), "utf-8").alias(c) for c in ("source", "lang")])
    fault = F.when((F.col("doc_id") % 11 > 7) | (F.octet_length("lang") == 0), -1).otherwise(F.col("doc_id") % 11)
    sized = lambda c: F.concat(octet(F.octet_length(c), 2), F.col(c))
    pick = lambda k, a, b: F.when(fault == k, F.lit(a)).otherwise(F.lit(b))
    length = octet(F.when(fault == 1, 2).otherwise(F.col("doc_id") % 4) + 0xFC)
    more = F.when(fault == 4, F.lit(b"\x00")).when(fault == 5, F.lit(b"\xfd\xf8\xf8\x01")).when(fault == 6, F.lit(b"\xfd\xf8\xf8\x00")).otherwise(F.lit(b""))
    content = F.concat(pick(0, b"\x02", b"\x01"), F.lit(b"\x64\x00\x1f"), length, pick(2, b"\xe2", b"\xe1"), sized("source"), pick(3, b"\x02", b"\x01"), sized("lang"), more)
    content = F.when(fault == 7, F.substring(content, 1, 7)).otherwise(content)
    found = rows.select("doc_id", media.avc_config(content).alias("c"))
    return found.select("doc_id", "c.length_size", F.decode("c.sps", "utf-8").alias("sps"), F.decode("c.pps", "utf-8").alias("pps"), "c.error")


RATES = "[" + ", ".join(map(str, arith.SAMPLE_RATES)) + "]"


@query("audio_config", f"""
    SELECT p_partkey, 2::int AS object_type, (CASE WHEN p_size % 16 = 15 THEN p_partkey WHEN p_size % 16 > 12 THEN NULL ELSE {RATES}[p_size % 16 + 1] END)::bigint AS sample_rate, (p_partkey % 8)::int AS channels FROM part""")
def audio_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, channels = (F.col("p_size") % 16).cast("long"), F.col("p_partkey") % 8
    short = F.shiftleft(F.lit(2).cast("long"), 11) + F.shiftleft(index, 7) + F.shiftleft(channels, 3)
    long = F.shiftleft(F.lit(2 * 16 + 15).cast("long"), 31) + F.shiftleft(F.col("p_partkey"), 7) + F.shiftleft(channels, 3)
    content = F.when(index == 15, octet(long, 5)).otherwise(F.concat(octet(short, 2), F.unhex(F.lit("000000"))))
    return table(spark, sf_dir, "part").select("p_partkey", media.audio_config(content).alias("c")).select("p_partkey", "c.*")


@query("adts_frames", f"""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'Invalid' WHEN l_linenumber = 4 THEN 'Unsupported' END AS error,
        CASE WHEN l_linenumber NOT IN (3, 4) THEN 'aac_lc' END AS codec, CASE WHEN l_linenumber NOT IN (3, 4) THEN 44100 END::int AS sample_rate, CASE WHEN l_linenumber NOT IN (3, 4) THEN 2 END::int AS channels,
        CASE WHEN l_linenumber NOT IN (3, 4) THEN 7 END::int AS header_size, CASE WHEN l_linenumber NOT IN (3, 4) THEN length(l_returnflag || l_linestatus) + l_quantity::int END::int AS data_size
    FROM lineitem WHERE l_linenumber <> 2""")
def adts_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("l_returnflag", "l_linestatus", F.repeat(F.lit("x"), F.col("l_quantity").cast("int")))
    rows = table(spark, sf_dir, "lineitem").withColumn("body", F.encode(body, "utf-8"))
    whole = F.concat(media.adts_header(F.octet_length("body"), 44_100, 2), F.col("body"))
    mpeg2 = F.concat(F.unhex(F.lit("FFF9")), F.substring(whole, 3, 1 << 20))
    content = F.when(F.col("l_linenumber") == 2, F.substring(whole, 1, 8)).when(F.col("l_linenumber") == 3, F.concat(octet(F.lit(0)), whole)).when(F.col("l_linenumber") == 4, mpeg2).otherwise(whole)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return rows.select(*keys, media.adts(content).alias("c")).where("c is not null").select(*keys, "c.*")


@query("bit_fields", "SELECT doc_id, (ascii(source) >> 4)::bigint AS high, (ascii(source) & 15)::bigint AS low, ((ascii(source) & 7) * 32 + (ascii(source[2:]) >> 3))::bigint AS across, lower(hex(encode(source))) AS dump FROM documents WHERE length(source) > 1")
def bit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode("source", "utf-8")
    rows = table(spark, sf_dir, "documents").where("length(source) > 1")
    return rows.select("doc_id", octets.bits(content, 0, 4).alias("high"), octets.bits(content, 4, 4).alias("low"), octets.bits(content, 5, 8).alias("across"), F.replace(media.hex_dump(content), F.lit(" ")).alias("dump"))


@query("mp4_boxes", """
    WITH d AS (SELECT doc_id, strlen(source) AS a, strlen(lang) AS b FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
    SELECT doc_id, 'ftyp' AS type, 0::bigint AS "offset", (a + 8)::bigint AS size, 0::int AS depth FROM d UNION ALL SELECT doc_id, 'moov', a + 8, b + 24, 0 FROM d
    UNION ALL SELECT doc_id, 'trak', a + 16, b + 16, 1 FROM d UNION ALL SELECT doc_id, 'tkhd', a + 24, b + 8, 2 FROM d""")
def mp4_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null")

    def box(kind: str, body: Column) -> Column:
        return F.concat(octet(F.octet_length(body) + 8, 4), F.encode(F.lit(kind), "utf-8"), body)

    content = F.concat(box("ftyp", F.encode("source", "utf-8")), box("moov", box("trak", box("tkhd", F.encode("lang", "utf-8")))))
    found = readers.mp4_boxes(rows.select("doc_id", content.alias("content")))
    return found.select("doc_id", F.explode("boxes").alias("b")).select("doc_id", "b.*")


@query("offset_repair", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN x > 4294934527 THEN x - 4294967296 ELSE x END AS repaired FROM (SELECT *, (4294967295 - l_partkey * l_linenumber * 5) AS x FROM lineitem)")
def offset_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.lit(4294967295).cast("long") - F.col("l_partkey") * F.col("l_linenumber") * 5
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", arith.repaired_offset(stored).alias("repaired"))


# ---------------------------------------------------------------- sizes, settings, texts

@query("display_sizes", """
    SELECT o_orderkey, CASE WHEN pw > ph THEN w * pw // ph - (w * pw // ph) % 2 ELSE w END AS width, CASE WHEN ph > pw THEN h * ph // pw - (h * ph // pw) % 2 ELSE h END AS height
    FROM (SELECT o_orderkey, 16 + o_orderkey % 1900 AS w, 16 + o_custkey % 1000 AS h, 1 + o_orderkey % 5 AS pw, 1 + o_custkey % 4 AS ph FROM orders)""")
def display_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w, h = arith.display_size(k % 1900 + 16, c % 1000 + 16, k % 5 + 1, c % 4 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", w.alias("width"), h.alias("height"))


@query("settings_rules", f"""
    WITH p AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN 'aac_lc' WHEN 1 THEN 'vorbis' WHEN 2 THEN 'pcm_s16le' WHEN 3 THEN 'png' WHEN 4 THEN 'h264' END AS codec, p_partkey * 37 % 50000 AS rate FROM part)
    SELECT p_partkey, coalesce(codec = 'aac_lc', false) AS aac, coalesce(codec = 'pcm_s16le', false) AS pcm, coalesce(codec = 'png', false) AS image, rate IN {tuple(arith.SAMPLE_RATES)} AS known_rate,
        p_partkey BETWEEN 1 AND 8192 AND p_size * 200 BETWEEN 1 AND 8192 AS dimensions, p_partkey BETWEEN 1 AND 16384 AND p_size * 400 BETWEEN 1 AND 16384 AND p_partkey * p_size * 400 <= 67108864 AS image_size,
        (CASE WHEN rate < 8000 THEN NULL WHEN rate < 9000 THEN least(60000, 42000) WHEN rate < 15000 THEN least(60000, 50000) WHEN rate < 19000 THEN 60000 WHEN rate < 26000 THEN 60000 ELSE 60000 END)::int AS bitrate,
        floor(p_size / 10 * 1000 + 0.5)::int AS h264_rate, floor(greatest(p_size / 10, 1.0) * 1000 + 0.5)::int AS vp8_rate,
        CASE codec WHEN 'aac_lc' THEN 'AAC (LC)' WHEN 'vorbis' THEN 'Vorbis [decode not supported]' WHEN 'pcm_s16le' THEN 'PCM (Signed 16-bit Little Endian)' ELSE 'Unknown' END AS shown,
        coalesce(['Landscape', 'Portrait', 'Landscape Reverse', 'Portrait Reverse'][p_size % 5 + 1], 'Unknown orientation') AS orientation
    FROM p""")
def settings_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = F.get(F.array(*map(F.lit, ("aac_lc", "vorbis", "pcm_s16le", "png", "h264"))), (F.col("p_partkey") % 6).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", codec.alias("codec"), (F.col("p_partkey") * 37 % 50_000).alias("rate"))
    c, fps = F.col("codec"), F.col("p_size") / 10
    return rows.select(
        "p_partkey", arith.is_aac(c).alias("aac"), arith.is_pcm(c).alias("pcm"), arith.is_image(c).alias("image"), arith.known_sample_rate(F.col("rate")).alias("known_rate"),
        arith.valid_dimensions(F.col("p_partkey"), F.col("p_size") * 200).alias("dimensions"), arith.valid_image_size(F.col("p_partkey"), F.col("p_size") * 400).alias("image_size"),
        arith.vorbis_bitrate(F.col("rate"), F.lit(1), F.lit(60_000)).alias("bitrate"), arith.encoder_rate(fps).alias("h264_rate"), arith.encoder_rate(fps, "vp8").alias("vp8_rate"),
        media.shown_codec(c, "audio").alias("shown"), media.shown_orientation(F.col("p_size") % 5).alias("orientation"),
    )


@query("text_arguments", """
    SELECT o_orderkey, (o_orderkey % 100)::double / 4 AS audio0, -1.0::double AS video1, 2::int AS pairs, CASE WHEN o_orderkey % 6 <> 5 THEN (o_orderkey % 900)::int END AS width,
        CASE o_orderkey % 6 WHEN 0 THEN (o_custkey % 700)::int WHEN 1 THEN (o_custkey % 700)::int WHEN 2 THEN (o_custkey % 700)::int WHEN 5 THEN NULL ELSE (o_orderkey % 900)::int END AS height, CASE WHEN o_orderkey % 6 <> 5 THEN o_orderkey % 6 IN (0, 3, 4) END AS percent,
        CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE (o_orderkey % 900)::int END AS region_width, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 0 THEN (o_orderkey % 50)::int WHEN 3 THEN (o_orderkey % 50)::int ELSE 0 END AS left,
        CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 0 THEN (o_custkey % 60)::int WHEN 1 THEN (o_custkey % 60)::int ELSE 0 END AS top,
        CASE WHEN o_orderkey % 7 <> 6 THEN CASE WHEN o_orderkey % 7 = 5 THEN 0 ELSE (o_orderkey % 256)::int END END AS r, CASE WHEN o_orderkey % 7 <> 6 THEN CASE WHEN o_orderkey % 7 = 5 THEN 0 ELSE (o_custkey % 256)::int END END AS g,
        CASE WHEN o_orderkey % 7 < 6 THEN 16::int END AS b, o_orderkey % 3 <> 0 AS digits FROM orders""")
def text_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    form = lambda n, *cases: F.coalesce(*[F.when(k % n == i, t) for i, t in enumerate(cases)])
    w, h, x, y = k % 900, c % 700, k % 50, c % 60
    sizes = form(6, text(w, "%x", h, "%"), text(w, "x", h), text(w, "x", h, " pixels"), text(w, "%"), text(w), text("x", h))
    regions = form(5, text(w, "x", h, "L", x, "T", y), text(w, "x", h, "T", y), text(w, "x", h, "and more"), text(w, "x", h, "L", x), text(w, "by", h))
    full = text("#", _hex(octet(k % 256)), _hex(octet(c % 256)), "10")
    colours = F.when(k % 7 == 6, text("rgb", w)).when(k % 7 == 5, F.lit("#10")).otherwise(full)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", octets.offsets(text((k % 100).cast("double") / 4, ":0.5;0.25:-1.0")).alias("o"), octets.wanted_size(sizes).alias("s"), octets.region(regions).alias("g"), octets.hex_colour(colours).alias("h"),
        media.digits(F.when(k % 3 == 0, text(k, "\n")).otherwise(k.cast("string"))).alias("digits"),
    )
    return rows.select(
        "o_orderkey", F.col("o")[0]["audio"].alias("audio0"), F.col("o")[1]["video"].alias("video1"), F.size("o").alias("pairs"), "s.width", "s.height", "s.percent", F.col("g.width").alias("region_width"), F.col("g.left"), F.col("g.top"),
        "h.r", "h.g", "h.b", "digits",
    )


@query("time_rescale", f"""
    SELECT track_id, idx, (dts * 48000 + 500000000) // 1000000000 AS from_ns, CASE WHEN idx % 4 = 0 THEN pts ELSE dts + (idx % 4) * 250000 END AS moved, size // 7 AS whole, size % 7 AS rest, round(size / 7, 9) AS value,
        round(2.0 + (size - 2.0) * 0.25, 9) AS between, least(greatest(size, 20), 40) AS kept, (size + 1) >> 1 AS half FROM {SAMPLES}""")
def time_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, quarter = F.col("size"), (F.col("idx") % 4)
    offset = F.when(quarter == 0, F.lit(-1.0)).otherwise(quarter * 0.25)
    return views.samples(spark, sf_dir).select(
        "track_id", "idx", arith.ns_to_ticks(F.col("dts"), F.lit(48_000).cast("long")).alias("from_ns"), arith.shifted_dts(F.col("dts"), F.col("pts"), offset, F.col("timescale")).alias("moved"),
        arith.rational_whole(size, 7).cast("int").alias("whole"), arith.rational_rest(size, 7).alias("rest"), F.round(arith.rational_value(size, 7), 9).alias("value"),
        F.round(arith.lerp(F.lit(2.0), size.cast("double"), 0.25), 9).alias("between"), arith.clamp(size, F.lit(20), F.lit(40)).alias("kept"), arith.half_rounded(size).alias("half"),
    )


# ---------------------------------------------------------------- colours and planes

_LINEAR = "pow({} / 255.0::double, 2.2::double)"


@query("colour_spaces", f"""
    WITH u AS (SELECT *, r / 255.0::double AS ur, g / 255.0::double AS ug, b / 255.0::double AS ub FROM {PIXELS}),
    h AS (SELECT *, greatest(ur, ug, ub) AS hi, greatest(ur, ug, ub) - least(ur, ug, ub) AS d FROM u),
    s AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = ur THEN (ug - ub) / d WHEN hi = ug THEN (ub - ur) / d + 2 ELSE (ur - ug) / d + 4 END / 6 AS sector FROM h)
    SELECT frame_id, i::int AS i, round({_LINEAR.format("r")}, 6) AS linear, greatest(0, least(255, trunc((ur * 0.75::double + 0.0987::double) * 255)))::int AS back, greatest(0, least(255, trunc((ur * 3 - 1.0007::double) * 255)))::int AS kept, round(CASE WHEN sector < 0 THEN sector + 1 ELSE sector END, 6) AS h, round(CASE WHEN hi = 0 THEN 0 ELSE d / hi END, 6) AS s, round(hi, 6) AS v,
        round(pow({_LINEAR.format("r")} * 0.25 + {_LINEAR.format("g")} * 0.75, 1 / 2.2::double), 6) AS mixed, greatest(0, least(255, trunc((r - 16) * 255 / 219)))::int AS wide,
        ((r + g + b + r) >> 2)::int AS chroma, round(0.2126 * {_LINEAR.format("r")} + 0.7152 * {_LINEAR.format("g")} + 0.0722 * {_LINEAR.format("b")}, 6) AS luminance
    FROM s""")
def colour_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = (F.col(c) for c in "rgb")
    unit = [colour.byte_to_unit(c) for c in (r, g, b)]
    lin = [colour.to_linear(u) for u in unit]
    rows = pixels(spark, sf_dir)
    found = rows.select(
        "frame_id", "i", F.round(lin[0], 6).alias("linear"), colour.unit_to_byte(unit[0] * 0.75 + 0.0987).alias("back"), colour.unit_to_byte(unit[0] * 3 - 1.0007).alias("kept"), colour.hsv(*unit).alias("hsv"), F.round(colour.over(unit[0], unit[1], F.lit(0.25)), 6).alias("mixed"),
        colour.full_range(r).alias("wide"), colour.chroma_average(r, g, b, r).alias("chroma"), F.round(arith.luminance(*lin), 6).alias("luminance"),
    )
    return found.select("frame_id", "i", "linear", "back", "kept", *[F.round(f"hsv.{c}", 6).alias(c) for c in "hsv"], "mixed", "wide", "chroma", "luminance")


@query("opaque_planes", f"SELECT frame_id, list_min(plane) >= 125 AS opaque FROM {FRAMES}")
def opaque_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphas = F.transform("plane", lambda x: F.when(x >= 125, 255).otherwise(x))
    return views.frames(spark, sf_dir).select("frame_id", colour.all_opaque(alphas).alias("opaque"))


@query("gravity_regions", """
    WITH p AS (SELECT p_partkey, p_size, p_size * 10 AS w, (p_partkey % 100) * 8 AS h, p_size * 4 + p_partkey % 7 * 50 AS rw, p_size * 2 + p_partkey % 5 * 100 AS rh FROM part)
    SELECT p_partkey, greatest(w - rw, 0)::int // 2 AS center_left, greatest(h - rh, 0)::int // 2 AS center_top, greatest(w - rw, 0)::int AS right_left, greatest(h - rh, 0)::int AS bottom_top, least(w, rw)::int AS width, least(h, rh)::int AS height,
        (CASE WHEN h > w THEN 0 ELSE greatest(h - rh, 0) // 2 END)::int AS own_top, CASE p_size % 9 WHEN 6 THEN 1 WHEN 3 THEN 2 WHEN 8 THEN 3 ELSE 0 END::int AS turns, (p_size % 4)::int AS quarter FROM p""")
def gravity_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey")
    at = lambda g: images.gravity_region(n * 10, (k % 100) * 8, n * 4 + k % 7 * 50, n * 2 + k % 5 * 100, g)
    quarter = n % 4
    m = images.matrix_of_rotation(quarter)
    back = images.rotation_of_matrix(F.get(m, F.lit(0)), F.get(m, F.lit(1)))
    whole = lambda c: c.cast("int")
    return table(spark, sf_dir, "part").select(
        "p_partkey", whole(at("center")["left"]).alias("center_left"), whole(at("center")["top"]).alias("center_top"), whole(at("right")["left"]).alias("right_left"), whole(at("bottom")["top"]).alias("bottom_top"),
        whole(at("left")["width"]).alias("width"), whole(at("top")["height"]).alias("height"), whole(at("heuristic")["top"]).alias("own_top"), images.turns(n % 9).alias("turns"), back.alias("quarter"),
    )


@query("pcm_decode", f"""
    WITH s AS (SELECT frame_id, plane FROM {FRAMES}),
    v AS (SELECT frame_id, [CASE WHEN x > 32767 THEN x - 65536 ELSE x END FOR x IN [plane[2 * k + 2] * 256 + plane[2 * k + 1] FOR k IN range(32)]] AS le, [CASE WHEN x > 32767 THEN x - 65536 ELSE x END FOR x IN [plane[3 * k + 1] * 256 + plane[3 * k + 2] FOR k IN range(21)]] AS be FROM s)
    SELECT frame_id, array_to_string(le, ',') AS little, array_to_string(be, ',') AS big, array_to_string([trunc((le[2 * k + 1] + le[2 * k + 2]) / 2)::int FOR k IN range(16)], ',') AS half FROM v""")
def pcm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.unhex(F.array_join(F.transform("plane", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    rows = views.frames(spark, sf_dir).select("frame_id", containers.decoded_pcm(content).alias("le"), containers.decoded_pcm(content, 24, little=False).alias("be"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("frame_id", text(F.col("le")).alias("little"), text(F.slice("be", 1, 21)).alias("big"), text(containers.halved(F.col("le"))).alias("half"))
