"""Image metadata in either byte order and malformed, colours and palettes on small images, text arguments, retiming rules."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import colour, media, octets
from trackloom.functions.timed import timed_info
from trackloom.operators import images, retiming
from trackloom.plans.catalog import QUERIES
from trackloom.sources import exif


def block(order, directories, after=b""):
    """A block from (entries, next) directories laid one after the other; an entry is (tag, type, count, four bytes or a number)."""
    out = (b"MM" if order == ">" else b"II") + struct.pack(order + "HI", 42, 8)
    for entries, following in directories:
        out += struct.pack(order + "H", len(entries))
        for tag, kind, count, value in entries:
            out += struct.pack(order + "HHI", tag, kind, count) + (value if isinstance(value, bytes) else struct.pack(order + "I", value))
        out += struct.pack(order + "I", following)
    return out + after


def read(spark, *blocks, **options):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i long, content binary")
    return exif.read(rows, **options).orderBy("i").collect()


@pytest.mark.parametrize("order", [">", "<"])
def test_metadata_in_either_order(spark, order):
    image = [(0x010F, 2, 4, b"abc\x00"), (0x0112, 3, 1, struct.pack(order + "HH", 6, 0)), (0x8825, 4, 1, 8 + 2 + 12 * 4 + 4), (0x011A, 5, 1, 104)]
    gps = [(1, 2, 2, b"N\x00\x00\x00"), (5, 1, 1, b"\x01\x00\x00\x00"), (6, 10, 1, 112)]
    data = block(order, [(image, 0), (gps, 0)])
    data = data.ljust(104, b"\x00") + struct.pack(order + "IIII", 72, 1, 5, 2)
    for found in read(spark, data, b"Exif\x00\x00" + data):
        assert (found["make"], found["orientation"], found["latitude_ref"], found["altitude_ref"]) == ("abc", 6, "N", 1)
        assert tuple(found["x_resolution"]) == (72, 1) and tuple(found["altitude"]) == (5, 2) and found["model"] is None


def test_malformed_metadata(spark):
    """Cycles end, what is wrong is missing, and defaults stand for it; of a tag that stands twice the first valid one counts."""
    loop = block(">", [([(0x8769, 4, 1, 8), (0x010F, 2, 3, b"me\x00\x00")], 8)])
    bad = block(">", [([(0x0112, 3, 1, b"\x00\x09\x00\x00"), (0x0112, 3, 1, b"\x00\x03\x00\x00"), (0x010F, 2, 3, b"abcd"), (0x0110, 2, 300, 8), (0x0131, 2, 20, 5000), (0x011A, 5, 1, 5000), (0x0128, 4, 1, b"\x00\x02\x00\x00")], 0)])
    zero = block(">", [([(0x011A, 5, 1, 26)], 0)], struct.pack(">II", 1, 0))
    named_only = block(">", [([(0x8825, 4, 1, 4_000_000_000)], 0)])
    found = read(spark, loop, bad, zero, named_only, None, b"", b"MM", b"XX\x00\x2a\x00\x00\x00\x08" + bytes(30), loop[:20], defaults={"orientation": 1, "software": "none"})
    assert found[0]["make"] == "me"
    assert (found[1]["orientation"], found[1]["make"], found[1]["model"], found[1]["software"], found[1]["x_resolution"], found[1]["resolution_unit"]) == (3, None, None, "none", None, None)
    assert found[2]["x_resolution"] is None
    assert all((r["orientation"], r["make"]) == (1, None) for r in found[3:])


def test_metadata_round_trip_of_what_is_there(spark):
    rows = spark.createDataFrame([(1, "x" * 400, None), (2, "", 5), (3, None, None)], "i long, make string, orientation int")
    found = {r["i"]: r for r in exif.read(exif.written(rows).drop("make", "orientation")).collect()}
    assert found[1]["make"] == "x" * 254 and found[1]["orientation"] is None and found[2]["orientation"] == 5 and found[2]["make"] == "" and found[3]["make"] is None


# ---------------------------------------------------------------- colours

def test_lab_of_known_colours(spark):
    """Red's share of the way through the range, and back again."""
    rows = spark.createDataFrame([(1.0, 0.0, 0.0), (0.2, 0.4, 0.6), (1.0, 1.0, 1.0)], "r double, g double, b double")
    found = rows.select("*", colour.lab(F.col("r"), F.col("g"), F.col("b")).alias("c")).withColumn("back", colour.srgb_of_lab(F.col("c"))).collect()
    assert [round(found[0]["c"][k], 3) for k in "lab"] == [0.532, 0.902, 0.135]
    for r in found:
        assert np.allclose([r["back"][k] for k in "rgb"], [r["r"], r["g"], r["b"]], atol=2e-3)


@pytest.mark.parametrize("space", ["lab", "hsv"])
def test_box_sums(spark, space):
    """Running sums give what adding each box up gives, round the first axis or not."""
    size, reach = images.SEARCH[space]
    volume = np.random.default_rng(1).normal(size=(size,) * 3).round(3)
    sums = images._box_sums(volume, reach, space == "hsv")
    rng = np.random.default_rng(2)
    for x, y, z in [(0, 0, 0), (size - 1,) * 3, *rng.integers(0, size, (40, 3)).tolist()]:
        total = 0.0
        for i in range(-reach[0], reach[0] + 1):
            at = x + i
            if space == "hsv":
                at = at - size if at >= size else size + at - 1 if at < 0 else at
            elif not 0 <= at < size:
                continue
            total += volume[at, max(0, y - reach[1]) : y + reach[1] + 1, max(0, z - reach[2]) : z + reach[2] + 1].sum()
        assert sums[x, y, z] == pytest.approx(total, abs=1e-5)


def test_palette_of_two_colours(spark):
    """The larger share first, real colours, pixels without alpha left out but counted in the whole."""
    rows = [(1, i, 250, 10, 10, 255) for i in range(60)] + [(1, 60 + i, 10, 10, 250, 255) for i in range(30)] + [(1, 90 + i, 0, 250, 0, 128) for i in range(10)]
    df = spark.createDataFrame(rows, "image int, i int, r int, g int, b int, a int")
    found = images.palette(df, ["image"], 3, ["i"]).orderBy("place").collect()
    assert [(r["r"], r["g"], r["b"], round(r["share"], 3)) for r in found] == [(250, 10, 10, 0.6), (10, 10, 250, 0.3)]
    assert images.palette(df, ["image"], 1, ["i"]).first()["r"] == 250
    assert images.palette(df.where("a < 200"), ["image"], 3, ["i"]).count() == 0


def test_means_read_each_colour_once_a_round(spark, monkeypatch):
    read, nearest = [], images._nearest
    monkeypatch.setattr(images, "_nearest", lambda points, *more: read.append(points.count()) or nearest(points, *more))
    rows = [("a", float(x), 0.0) for x in (0, 0, 0, 4, 9, 9)] + [("b", 5.0, 5.0)] * 3
    found = images.means(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], ["x", "y"], 2).orderBy("k", "n").collect()
    assert [tuple(r) for r in found] == [("a", 0, 1.0, 0.0), ("a", 1, 9.0, 0.0), ("b", 0, 5.0, 5.0)]
    assert set(read) == {4}


# ---------------------------------------------------------------- arguments and timed metadata

def test_text_arguments_never_fail(spark):
    texts = ["10x20", "10x20T5", "10x20L3", "10x20L3T4", "x", "", None, "99999999999x1", "10%x20%", "7", "7%", "#12", "#1234567", "#zz", "# 1"]
    found = {r["t"]: r for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", octets.region(F.col("t")).alias("g"), octets.wanted_size(F.col("t")).alias("s"), octets.hex_colour(F.col("t")).alias("h")).collect()}
    assert [tuple(found[t]["g"]) for t in texts[:4]] == [(10, 20, 0, 0), (10, 20, 0, 5), (10, 20, 3, 0), (10, 20, 3, 4)]
    assert all(found[t]["g"] is None for t in texts[4:])
    assert tuple(found["10%x20%"]["s"]) == (10, 20, True) and tuple(found["7"]["s"]) == tuple(found["7%"]["s"]) == (7, 7, True) and tuple(found["10x20T5"]["s"]) == (10, 20, False)
    assert found["99999999999x1"]["s"] is None and tuple(found["#12"]["h"]) == (0, 0, 0x12) and all(found[t]["h"] is None for t in ("#1234567", "#zz", "# 1", "7"))


def test_configuration_of_any_bytes(spark):
    good = bytes.fromhex("0164001fffe1000267aa01000168")
    rows = [good, good + b"\xfd\xf8\xf8\x00", good[:-1], good[:9], b"", None, bytes(40), b"\xff" * 40]
    found = [r["c"] for r in spark.createDataFrame([(i, b) for i, b in enumerate(rows)], "i int, b binary").select("i", media.avc_config(F.col("b")).alias("c")).orderBy("i").collect()]
    assert [c and c["error"] for c in found] == [None, None, "Invalid", "Invalid", "Invalid", None, "Invalid", "Invalid"]
    assert (found[0]["length_size"], bytes(found[0]["sps"]), bytes(found[0]["pps"])) == (4, b"\x67\xaa", b"\x68")


def test_timed_info(spark):
    frame = lambda k, b: k + bytes([0, 0, len(b) >> 7, len(b) & 127, 0, 0]) + b
    clock, turn = frame(b"TIT3", b"\x0312.5x\x00"), frame(b"TKEY", b"\x03405\x00")
    rows = [clock + turn, turn + b"TIT" + clock + clock.replace(b"12", b"13"), frame(b"TIT3", b"\x035 TKEY\x00") + b"junk", b"", None, clock[:-2], frame(b"TKEY", b"\x00" * 3), b"TIT3"]
    found = [tuple(r["t"]) if r["t"] is not None else None for r in spark.createDataFrame([(i, b) for i, b in enumerate(rows)], "i int, b binary").select("i", timed_info(F.col("b")).alias("t")).orderBy("i").collect()]
    assert found == [(12.5, 1, None), (13.5, 1, None), (5.0, None, None), (None, None, None), None, (None, None, "Invalid"), (None, None, "Unsupported"), (None, None, "Invalid")]


def test_timed_info_decodes_a_sample_once(spark, data):
    """The bytes that a query makes are an expression, which is evaluated anew wherever it stands: once in the walk of a sample's frames, however many those are."""
    plan = QUERIES["timed_info"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("decode(") == 1


def test_retiming_rules(spark):
    played = spark.createDataFrame([(1, i, p) for i, p in enumerate([30, 10, -1, 20, 50])] + [(2, 0, 5)], "track_id long, idx long, real_pts long")
    encoded = spark.createDataFrame([(1, 0, 1000), (1, 1, 1000), (2, 0, 1000), (2, 1, 1000), (3, 0, 1000)], "track_id long, idx long, timescale long")
    pictures, tracks = retiming.retimed(encoded, played, 2)
    assert [(r["track_id"], r["idx"], r["pts"]) for r in pictures.orderBy("idx").collect()] == [(1, 0, 0), (1, 1, 20)]
    assert {r["track_id"]: r["error_category"] for r in tracks.collect()} == {1: None, 2: "Invalid", 3: "Invalid"}
    sound = spark.createDataFrame([(1, i, d, d, 1000) for i, d in enumerate([5, 10, 12, 25, 15])], "track_id long, idx long, pts long, dts long, timescale long")
    kept = retiming.sound_within(sound, pictures, tracks).orderBy("idx").collect()
    assert [(r["dts"], r["audio_first"]) for r in kept] == [(0, 10), (2, 10)]  # 25 isn't before the last picture, and 15 waits behind it
    with pytest.raises(ValueError, match="InvalidArguments"):
        retiming.retimed(encoded, played, 0)
