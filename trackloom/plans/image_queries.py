"""Queries over planes and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import colour
from trackloom.operators import compare, images
from trackloom.plans.catalog import query
from trackloom.sources import views
from trackloom.sources.views import FRAMES

#: Consecutive values of a plane as red, green and blue; beyond its 64 values there is 0.
PIXELS = f"(SELECT frame_id, label, i, coalesce(plane[3 * i + 1], 0) AS r, coalesce(plane[3 * i + 2], 0) AS g, coalesce(plane[3 * i + 3], 0) AS b FROM {FRAMES}, range(22) AS x(i))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frames(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(21))))
    return frames.select("frame_id", "label", "i", *[F.coalesce(F.get("plane", (F.col("i") * 3 + k)), F.lit(0)).alias(c) for k, c in enumerate("rgb")])


PAIRS = f"""(SELECT a.frame_id, list_sum(list_transform(range(1, 65), lambda i: (a.plane[i] - b.plane[i]) * (a.plane[i] - b.plane[i])))::bigint AS e, a.plane = b.plane AS same
    FROM {FRAMES} a JOIN {FRAMES} b ON b.frame_id = a.frame_id + 1)"""


@query("psnr_pairs", f"""
    SELECT frame_id, CASE WHEN same THEN 0 ELSE e END AS sse, CASE WHEN same THEN 0 ELSE 64 END::bigint AS pixels,
        CASE WHEN NOT same AND e > 0 THEN round(10 * log10(65025 / (e / 64)), 6) END AS psnr FROM {PAIRS}""")
def psnr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frames(spark, sf_dir)
    after = frames.select((F.col("frame_id") - 1).alias("frame_id"), "plane")
    return compare.plane_quality(frames, after, ["frame_id"]).withColumn("psnr", F.round("psnr", 6))


@query("psnr_overall", f"""
    SELECT sum(CASE WHEN same THEN 0 ELSE e END)::bigint AS sse, sum(CASE WHEN same THEN 0 ELSE 64 END)::bigint AS pixels,
        round(10 * log10(65025 / (sum(CASE WHEN same THEN 0 ELSE e END) / sum(CASE WHEN same THEN 0 ELSE 64 END))), 6) AS psnr FROM {PAIRS}""")
def psnr_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frames(spark, sf_dir)
    after = frames.select((F.col("frame_id") - 1).alias("frame_id"), "plane")
    return compare.overall_quality(compare.plane_quality(frames, after, ["frame_id"])).withColumn("psnr", F.round("psnr", 6))


@query("yuv_matrix", f"""
    SELECT frame_id, i::int AS i, ((r * 76 + g * 150 + b * 29) >> 8)::int AS y, (floor((r * -43 + g * -84 + b * 127) / 256.0) + 128)::int AS u, (floor((r * 127 + g * -106 + b * -21) / 256.0) + 128)::int AS v
    FROM {PIXELS}""")
def yuv_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("frame_id", "i", colour.yuv(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("frame_id", "i", "c.*")


@query("limited_range", f"SELECT frame_id, i::int AS i, (r * 219 // 255 + 16)::int AS y, (g * 224 // 255 + 16)::int AS u FROM {PIXELS}")
def limited_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("frame_id", "i", colour.limited_range(F.col("r")).alias("y"), colour.limited_range(F.col("g"), True).alias("u"))


# ---------------------------------------------------------------- colours

#: Fixed values, as written for the SQL: linear RGB to XYZ with its white, and the Lab range.
_XYZ = ((0.412453, 0.357580, 0.180423, 95.0429), (0.212671, 0.715160, 0.072169, 100.0), (0.019334, 0.119193, 0.950220, 108.8900))
_BACK = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


def _d(x: float) -> str:
    return f"({x!r}::double)"


_CURVED = ", ".join(
    f"CASE WHEN q{n} > 216.0::double / 24389.0::double THEN pow(q{n}, 0.333333::double) ELSE (24389.0::double / 27.0::double * q{n} + 16) / 116.0::double END AS f{n}" for n in "xyz"
)
_RATIOS = ", ".join("(" + " + ".join(f"pow({c} / 255.0::double, 2.2::double) * 100 * {_d(k)}" for c, k in zip("rgb", row[:3], strict=True)) + f") / {_d(row[3])} AS q{n}" for n, row in zip("xyz", _XYZ, strict=True))
#: Every pixel with its alpha and its relative Lab colour.
_LAB = f"""
    al AS (SELECT *, (r * 7 + i * 37) % 256 AS a FROM {PIXELS}), qs AS (SELECT *, {_RATIOS} FROM al), fs AS (SELECT *, {_CURVED} FROM qs),
    lb AS (
        SELECT *, (116 * fy - 16) / 100 AS cl, (500 * (fx - fy) - {_d(-86.1777648)}) / ({_d(98.2391204)} - {_d(-86.1777648)}) AS ca, (200 * (fy - fz) - {_d(94.4802017)}) / ({_d(-107.852676)} - {_d(94.4802017)}) AS cb FROM fs)"""


def seen_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("a", (F.col("r") * 7 + F.col("i") * 37) % 256)


_RGB = ", ".join(f"round(pow(greatest({' + '.join(f'{_d(k)} * w{n}' for n, k in zip('xyz', row, strict=True))}, 0), 1 / 2.2::double), 5) AS {c}" for c, row in zip("rgb", _BACK, strict=True))


@query("colour_lab", f"""
    WITH {_LAB}, o AS (SELECT frame_id, i, round(cl, 6) AS cl, round(ca, 6) AS ca, round(cb, 6) AS cb, (cl * 100 + 16) / 116 AS gy, cl * 100 AS la, (ca * ({_d(98.2391204)} - {_d(-86.1777648)}) + {_d(-86.1777648)}) / 500 AS ga,
        (cb * ({_d(-107.852676)} - {_d(94.4802017)}) + {_d(94.4802017)}) / 200 AS gb FROM lb),
    x AS (SELECT *, gy + ga AS gx, gy - gb AS gz FROM o),
    w AS (
        SELECT *, CASE WHEN gx * gx * gx > 216.0::double / 24389 THEN gx * gx * gx ELSE (116 * gx - 16) / (24389.0::double / 27) END * {_d(95.0429)} / 100 AS wx,
            CASE WHEN la > 216.0::double / 24389 THEN gy * gy * gy ELSE la / (24389.0::double / 27) END AS wy,
            CASE WHEN gz * gz * gz > 216.0::double / 24389 THEN gz * gz * gz ELSE (116 * gz - 16) / (24389.0::double / 27) END * {_d(108.89)} / 100 AS wz FROM x)
    SELECT frame_id, i::int AS i, cl, ca, cb, {_RGB} FROM w""")
def colour_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixels(spark, sf_dir).select("frame_id", "i", colour.lab(*[colour.byte_to_unit(F.col(c)) for c in "rgb"]).alias("c"))
    found = found.withColumn("back", colour.srgb_of_lab(F.col("c")))
    return found.select("frame_id", "i", *[F.round(f"c.{k}", 6).alias(f"c{k}") for k in "lab"], *[F.round(f"back.{k}", 5).alias(k) for k in "rgb"])


def _bin(v: str, size: int) -> str:
    return f"greatest(0, least({size - 1}, trunc({v} * {size})))::int"


_LAB_BINS = f"""{_LAB},
    px AS (SELECT *, {_bin("cl", 24)} AS x, {_bin("ca", 24)} AS y, {_bin("cb", 24)} AS z, greatest(abs(cl - 0.5), sqrt((ca - 0.5) * (ca - 0.5) + (cb - 0.5) * (cb - 0.5))) AS w FROM lb),
    h0 AS (SELECT label, x, y, z, round(sum(w), 6) AS w FROM px WHERE a > 128 GROUP BY ALL)"""
#: One colour: hue goes round, and what lies before the first bin is the last but one.
_HSV_BINS = f"""
    al AS (SELECT *, (r * 7 + i * 37) % 256 AS a, r / 255.0::double AS ur, g / 255.0::double AS ug, b / 255.0::double AS ub FROM {PIXELS}),
    hl AS (SELECT *, greatest(ur, ug, ub) AS hi, greatest(ur, ug, ub) - least(ur, ug, ub) AS d FROM al),
    hs AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = ur THEN (ug - ub) / d WHEN hi = ug THEN (ub - ur) / d + 2 ELSE (ur - ug) / d + 4 END / 6 AS s FROM hl),
    px AS (SELECT *, {_bin("CASE WHEN s < 0 THEN s + 1 ELSE s END", 16)} AS x, {_bin("CASE WHEN hi = 0 THEN 0 ELSE d / hi END", 16)} AS y, {_bin("hi", 16)} AS z FROM hs),
    h0 AS (SELECT label, x, y, z, count(*)::double AS w FROM px WHERE a > 128 GROUP BY ALL)"""


def _peak(k: int, size: int, reach: tuple[int, int, int], wraps: bool = False) -> str:
    """The k-th peak of the bins that are left, and the bins left after it."""
    x = "CASE WHEN b.x + i >= 16 THEN b.x + i - 16 ELSE b.x + i END" if wraps else "b.x + i"
    # A box at x looks at x + i, and below 0 at 16 + x + i - 1: a bin is seen from those x.
    spread = f"SELECT label, c.x AS x, y + j AS y, z + k AS z, w FROM h{k} b, range({size}) AS c(x), range(-{reach[1]}, {reach[1] + 1}) AS u(j), range(-{reach[2]}, {reach[2] + 1}) AS v(k), range(-{reach[0]}, {reach[0] + 1}) AS t(i) WHERE b.x = CASE WHEN c.x + i >= {size} THEN c.x + i - {size} WHEN c.x + i < 0 THEN {size} + c.x + i - 1 ELSE c.x + i END" if wraps else (
        f"SELECT label, {x} AS x, y + j AS y, z + k AS z, w FROM h{k} b, range(-{reach[0]}, {reach[0] + 1}) AS t(i), range(-{reach[1]}, {reach[1] + 1}) AS u(j), range(-{reach[2]}, {reach[2] + 1}) AS v(k)"
    )
    near = f"abs(h{k}.x - p{k}.x) <= {reach[0]} AND abs(h{k}.y - p{k}.y) <= {reach[1]} AND abs(h{k}.z - p{k}.z) <= {reach[2]}"
    return f"""
    s{k} AS (SELECT label, x, y, z, round(sum(w), 6) AS total FROM ({spread}) WHERE x BETWEEN 0 AND {size - 1} AND y BETWEEN 0 AND {size - 1} AND z BETWEEN 0 AND {size - 1} GROUP BY ALL),
    p{k} AS (SELECT label, {k} AS n, x, y, z, total FROM s{k} WHERE total > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY total DESC, x, y, z) = 1),
    h{k + 1} AS (SELECT h{k}.label, h{k}.x, h{k}.y, h{k}.z, CASE WHEN {near} THEN -abs(w) ELSE w END AS w FROM h{k} LEFT JOIN p{k} USING (label))"""


_PEAKS = f"{_LAB_BINS}, {', '.join(_peak(k, 24, (4, 1, 1)) for k in range(3))}, pk AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)"


@query("colour_histogram", f"WITH {_LAB_BINS} SELECT label, x, y, z, w AS weight FROM h0")
def colour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.histogram(seen_pixels(spark, sf_dir), ["label"])


@query("colour_peaks", f"WITH {_PEAKS} SELECT label, n::int AS n, x::int AS x, y::int AS y, z::int AS z, total FROM pk")
def colour_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.peaks(colour_histogram(spark, sf_dir), ["label"], 3)


@query("colour_peak_hsv", f"WITH {_HSV_BINS}, {_peak(0, 16, (1, 2, 4), True)} SELECT label, n::int AS n, x::int AS x, y::int AS y, z::int AS z, total FROM p0")
def colour_peak_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.peaks(images.histogram(seen_pixels(spark, sf_dir), ["label"], "hsv"), ["label"], 1, "hsv")


def _palette(inside: str) -> str:
    return f"""
    n AS (SELECT label, count(*) AS pixels FROM px GROUP BY label),
    e AS (SELECT px.label, pk.n, px.frame_id, px.i, r, g, b FROM px JOIN pk ON pk.label = px.label AND a > 128 AND {inside}),
    m AS (SELECT label, n, list_sort(list(r))[count(*) // 2 + 1] AS mr, list_sort(list(g))[count(*) // 2 + 1] AS mg, list_sort(list(b))[count(*) // 2 + 1] AS mb, count(*) AS size FROM e GROUP BY ALL),
    f AS (SELECT e.*, size, row_number() OVER (PARTITION BY label, n ORDER BY (r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb), frame_id, i) AS k FROM e JOIN m USING (label, n)),
    v AS (SELECT label, n, r, g, b, size / pixels AS share FROM f JOIN n USING (label) WHERE k = 1)
    SELECT label, (row_number() OVER (PARTITION BY label ORDER BY share DESC, n) - 1)::int AS place, r::int AS r, g::int AS g, b::int AS b, round(share, 6) AS share FROM v WHERE share > 0.001"""


@query("palette_medians", f"WITH {_PEAKS}, {_palette('abs(px.x - pk.x) <= 4 AND abs(px.y - pk.y) <= 1 AND abs(px.z - pk.z) <= 1')}")
def palette_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.palette(seen_pixels(spark, sf_dir), ["label"], 3, ["frame_id", "i"]).withColumn("share", F.round("share", 6))


@query("palette_one", f"WITH {_HSV_BINS}, {_peak(0, 16, (1, 2, 4), True)}, pk AS (SELECT * FROM p0), {_palette('abs(px.x - pk.x) % 16 <= 1 AND abs(px.y - pk.y) <= 2 AND abs(px.z - pk.z) <= 4')}")
def palette_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.palette(seen_pixels(spark, sf_dir), ["label"], 1, ["frame_id", "i"]).withColumn("share", F.round("share", 6))


@query("palette_nearest")
def palette_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir).select("label", "frame_id", "i", *[F.col(c).cast("double").alias(c) for c in "rgb"])
    palette = images.means(rows, ["label"], list("rgb"), 4)
    return images.nearest(rows, palette, ["label"], list("rgb")).select("label", "frame_id", "i", "n")


@query("kernel_weights", """
    WITH o AS (SELECT i AS out_idx, (i + 0.5::double) * (64.0::double / 24) AS c FROM range(24) AS r(i)),
    t AS (SELECT out_idx, c, tap, (tap + 0.5::double - c) / (64.0::double / 24) AS x FROM o, range(64) AS q(tap) WHERE tap BETWEEN floor(c - 8) AND ceil(c + 8)),
    k AS (SELECT *, CASE WHEN abs(x) >= 3 THEN 0 WHEN abs(x) < 1e-9 THEN 1 ELSE sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) END AS raw FROM t)
    SELECT out_idx, tap, round(raw / sum(raw) OVER (PARTITION BY out_idx), 6) AS weight FROM k WHERE raw <> 0""")
def kernel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.weights(spark, 64, 24).select("out_idx", "tap", F.round("weight", 6).alias("weight"))


@query("plane_crop_rotate", f"""
    SELECT frame_id, array_to_string([plane[8 * (2 + k // 4) + 1 + k % 4 + 1] FOR k IN range(16)], ',') AS crop,
        array_to_string([plane[(7 - k % 8) * 8 + k // 8 + 1] FOR k IN range(64)], ',') AS turned,
        array_to_string([(plane[16 * (k // 4) + 2 * (k % 4) + 1] + plane[16 * (k // 4) + 2 * (k % 4) + 2] + plane[16 * (k // 4) + 2 * (k % 4) + 9] + plane[16 * (k // 4) + 2 * (k % 4) + 10] + 2) >> 2 FOR k IN range(16)], ',') AS half
    FROM {FRAMES}""")
def plane_crop_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = F.col("plane")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return views.frames(spark, sf_dir).select("frame_id", text(images.cropped(plane, 8, 1, 2, 4, 4)).alias("crop"), text(images.rotated(plane, 8, 8, 1)).alias("turned"), text(images.halved_plane(plane, 8, 8)).alias("half"))


_TAPS = """
    o AS (SELECT i AS out_idx, (i + 0.5::double) * 2 AS c FROM range(4) AS r(i)),
    k AS (SELECT out_idx, tap, (tap + 0.5::double - c) / 2 AS x FROM o, range(8) AS q(tap) WHERE tap BETWEEN floor(c - 6) AND ceil(c + 6)),
    l AS (SELECT *, CASE WHEN abs(x) >= 3 THEN 0 WHEN abs(x) < 1e-9 THEN 1 ELSE sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) END AS raw FROM k),
    w AS (SELECT out_idx, tap, round(raw / sum(raw) OVER (PARTITION BY out_idx) * 65536)::bigint AS f FROM l WHERE raw <> 0)"""


@query("resample_planes", f"""
    WITH {_TAPS}, p AS (SELECT frame_id, i % 8 AS x, i // 8 AS y, plane[i + 1] AS v FROM {FRAMES}, range(64) AS r(i)),
    h AS (SELECT frame_id, y, out_idx AS x, greatest(0, least(255, (sum(v * f) + 32768)::bigint >> 16)) AS v FROM p JOIN w ON tap = x GROUP BY frame_id, y, out_idx)
    SELECT frame_id, x::int AS x, out_idx::int AS y, greatest(0, least(255, (sum(v * f) + 32768)::bigint >> 16))::int AS v FROM h JOIN w ON tap = y GROUP BY frame_id, x, out_idx""")
def resample_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    taps = images.weights(spark, 8, 4)
    values = images.pixels_of(views.frames(spark, sf_dir), ["frame_id"], "plane", 8)
    return images.resampled(images.resampled(values, ["frame_id"], taps, "x"), ["frame_id"], taps, "y").select("frame_id", "x", "y", "v")


@query("range_lookup", f"SELECT frame_id, (i % 8)::int AS x, (i // 8)::int AS y, (plane[i + 1] * 219 // 255 + 16)::int AS out FROM {FRAMES}, range(64) AS r(i)")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.range(256).select(F.col("id").cast("int").alias("v"), colour.limited_range(F.col("id")).alias("out"))
    values = images.pixels_of(views.frames(spark, sf_dir), ["frame_id"], "plane", 8)
    return images.looked_up(values, table).select("frame_id", "x", "y", "out")


#: Frames of a label's image: regions that move and reach over its edges, all disposals, every fifth value transparent.
_SHOTS = f"""
    s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY frame_id) - 1 AS idx, frame_id % 3 AS l, frame_id % 2 AS t, 9 - frame_id % 4 AS w, 8 - frame_id % 3 AS h, (frame_id * 5 + frame_id // 7) % 4 AS d, plane FROM {FRAMES})"""


@query("frames_composited", f"""
    WITH RECURSIVE {_SHOTS},
    p AS (SELECT s.*, x, y, CASE WHEN x >= l AND x < l + w AND y >= t AND y < t + h THEN plane[((y - t) * w + x - l) % 64 + 1] END AS own FROM s, range(8) AS u(x), range(8) AS v(y)),
    q AS (SELECT label, idx, d, x, y, own IS NOT NULL AS inside, CASE WHEN own % 5 <> 0 THEN own * 2 + 1 END AS c, lag(d) OVER k AS before, lag(own IS NOT NULL) OVER k AS was FROM p WINDOW k AS (PARTITION BY label, x, y ORDER BY idx)),
    -- A pixel is its value doubled, plus one if it has alpha; kept is what it goes back to.
    r AS (
        SELECT label, idx, x, y, NULL::int AS kept, coalesce(c, CASE WHEN inside THEN 510 ELSE 0 END)::int AS shown FROM q WHERE idx = 0
        UNION ALL
        SELECT label, idx, x, y, saved, coalesce(c, CASE WHEN before = 2 AND was THEN 510 WHEN before = 3 AND saved IS NOT NULL THEN saved ELSE old END)::int
        FROM (SELECT q.*, r.shown AS old, CASE WHEN q.d = 3 AND q.before <> 3 THEN r.shown ELSE r.kept END AS saved FROM r JOIN q ON q.label = r.label AND q.x = r.x AND q.y = r.y AND q.idx = r.idx + 1))
    SELECT label, idx, x::int AS x, y::int AS y, (shown >> 1)::int AS v, (CASE WHEN shown & 1 = 1 THEN 255 ELSE 0 END)::int AS alpha FROM r""")
def frames_composited(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("frame_id")
    rows = views.frames(spark, sf_dir).withColumn("idx", (F.row_number().over(Window.partitionBy("label").orderBy("frame_id")) - 1).cast("long"))
    region = {"left": n % 3, "top": n % 2, "width": 9 - n % 4, "height": 8 - n % 3, "disposal": (n * 5 + F.floor(n / 7)) % 4}
    size = (9 - n % 4) * (8 - n % 3)
    value = lambda i: F.get("plane", (i % 64).cast("int"))
    values = F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda i: F.when(value(i) % 5 != 0, value(i)))
    return images.composited(rows.withColumns(region | {"values": values}), ["label"], 8, 8)
