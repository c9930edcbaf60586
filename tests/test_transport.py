"""Transport streams: plain loops over bytes against the operators, errors, and cuts at any place."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions import media
from trackloom.operators import captions
from trackloom.plans.catalog import QUERIES
from trackloom.sources import mp4, readers, transport

AUD, MARK = transport.DELIMITER, b"\x00\x00\x00\x01"
SETS = MARK + b"\x67s" + MARK + b"\x68p"


def packets(spark, rows, pid=256):
    return spark.createDataFrame([("f", pid, k, p, d, x) for k, (p, d, x) in enumerate(rows)], "path string, pid int, packet long, pts long, dts long, data binary")


def pictures(spark, rows):
    return sorted((r["idx"], r["pts"], r["dts"], r["keyframe"], bytes(r["content"]) if r["content"] is not None else None, r["error"]) for r in transport.pictures(packets(spark, rows)).collect())


def test_pictures_of_cut_packets(spark):
    key, one, two = MARK + b"\x65aaa", MARK + b"\x41bbb", MARK + b"\x41ccc"
    rows = [(10, 10, AUD + SETS + key[:3]), (None, None, key[3:]), (30, 20, AUD + one), (30, 20, b"more"), (40, 30, b"tail" + AUD[1:] + two), (90, 40, AUD + key)]
    assert pictures(spark, rows) == [(0, 10, 10, True, SETS + key, None), (1, 30, 20, False, one + b"moretail", None), (2, 40, 30, False, two, None), (3, 90, 40, True, SETS + key, None)]


@pytest.mark.parametrize(("rows", "errors"), [
    ([(1, 1, AUD + MARK + b"\x65a")], ["Invalid"]),  # a keyframe before any parameter sets
    ([(None, None, AUD + MARK + b"\x41a")], ["Invalid"]),  # no time
    ([(5, 5, AUD + MARK + b"\x41a"), (4, 4, AUD + MARK + b"\x41a")], [None, "Invalid"]),  # back in time
    ([(5, 5, AUD + MARK + b"\x41a"), (6, 6, b"rest")], ["Invalid"]),  # another time in the same picture
    ([(5, 5, AUD + MARK + b"\x67s" + MARK + b"\x41a")], ["Invalid"]),  # one parameter set alone
    ([(5, 5, AUD + SETS)], ["Invalid"]),  # no slice
    ([(5, 5, b"head" + AUD + MARK + b"\x41a")], ["Invalid", None]),  # data before the first delimiter
    ([((1 << 32) + 5, 5, AUD + MARK + b"\x41a")], [None]),
])
def test_picture_errors(spark, rows, errors):
    found = pictures(spark, rows)
    assert [r[-1] for r in found] == errors
    assert all(r[1] is None or r[1] < 1 << 32 for r in found)


def adts(body, rate=3):
    n = len(body) + 7
    return bytes([0xFF, 0xF1, 0x40 | rate << 2, 0x80 | n >> 11, n >> 3 & 0xFF, (n & 7) << 5 | 0x1F, 0xFC]) + body


def test_sounds_at_any_cut(spark):
    """Whatever the packets' sizes, the frames are the same; each has the time of the packet in which it begins."""
    rng = random.Random(1)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    data, begins = b"".join(map(adts, bodies)), []
    for b in bodies:
        begins.append((begins[-1][1] if begins else 0, (begins[-1][1] if begins else 0) + len(b) + 7))
    for _ in range(3):
        cuts, at = [0], 0
        while at < len(data):
            at = min(len(data), at + rng.randint(70, 200))
            cuts.append(at)
        rows = [(1000 * k, 1000 * k, data[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        wanted, nth = [], {}
        for (a, _), body in zip(begins, bodies):
            k = max(i for i, c in enumerate(cuts) if c <= a)
            nth[k] = nth.get(k, -1) + 1
            wanted.append((k, 1000 * k + 90000 * 1024 * nth[k] // 48000, body))
        found = transport.sounds(packets(spark, rows)).orderBy("idx").collect()
        assert [(r["packet"], r["pts"], bytes(r["content"])) for r in found] == wanted and all(r["error"] is None and r["sample_rate"] == 48000 for r in found)


def test_sound_errors(spark):
    whole = adts(b"x" * 50)
    spread = transport.sounds(packets(spark, [(1, 1, whole[:20]), (2, 2, whole[20:30]), (3, 3, whole[30:] + whole)])).collect()
    assert [r["error"] for r in spread] == ["Unsupported"]
    bad = transport.sounds(packets(spark, [(1, 1, whole + b"junk"), (2, 2, whole)])).orderBy("idx").collect()
    assert [r["error"] for r in bad] == [None, "Invalid"]
    assert transport.sounds(packets(spark, [(1, 1, whole[:30])])).count() == 0  # never ended
    assert transport.sounds(packets(spark, [])).count() == 0 and transport.pictures(packets(spark, [])).count() == 0


def carries(frames):
    out, held = [], 0
    for k, (pts, dts, key, size, unit) in enumerate(frames):
        total = held + 6 + size + 14 + (5 if pts != dts else 0) + (8 if key else 0)
        waits = total % 184
        waits = waits if size and k + 1 < len(frames) and total > 184 and waits + 33 <= 184 and unit >= waits else 0
        out.append((held, waits))
        held = waits
    return out


def test_carries_over_blocks(spark, monkeypatch):
    """Composed tables of small blocks give what a walk from the start gives."""
    rng = random.Random(2)
    frames = [(k + rng.randint(0, 1), k, rng.random() < 0.2, rng.choice([b"", MARK + b"\x41" + b"y" * rng.randint(1, 500), MARK + b"\x41" + b"y" * 300 + MARK + b"\x41z"])) for k in range(90)]
    monkeypatch.setattr(transport, "BLOCK", 7)
    df = spark.createDataFrame([("f", k, *f) for k, f in enumerate(frames)], "path string, idx long, pts long, dts long, keyframe boolean, content binary")
    unit = lambda c: -1 if not c else 2 if c.endswith(b"\x41z") else len(c) - 4
    wanted = carries([(p, d, key, len(c), unit(c)) for p, d, key, c in frames])
    assert [(r["held"], r["waits"]) for r in transport.carries(df).orderBy("idx").collect()] == wanted and any(w for _, w in wanted)
    joined = b"".join(bytes(r["data"]) for r in transport.video_packets(df).orderBy("packet").collect())
    assert joined.replace(AUD, b"") == b"".join(c for *_, c in frames)


def test_cells(spark):
    """Every cell has 188 bytes and its counter; packets of any size come back, the free byte of one included."""
    sizes = [1, 150, 168, 169, 170, 171, 172, 173, 174, 400, 70_000]
    rows = [("f", "video", k, 10 + k, 10, k % 3 == 0, bytes([65]) * n) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "path string, kind string, packet long, pts long, dts long, random boolean, data binary")
    laid = transport.packet_cells(df, ["packet"])
    held = laid.orderBy("n").collect()
    assert [r["n"] for r in held] == list(range(len(held))) and all(len(r["cell"]) == 188 and r["cell"][0] == 0x47 for r in held)
    assert [r["cell"][3] & 15 for r in held[2:]] == [k % 16 for k in range(len(held) - 2)]
    files = transport.as_files(laid)
    assert [(r["pid"], r["kind"]) for r in transport.streams(transport.cells(files)).collect()] == [(256, "video")]
    back = transport.packets(transport.cells(files)).orderBy("packet").collect()
    assert [(r["pts"], r["dts"], len(r["data"])) for r in back] == [(10 + k, 10, n) for k, n in enumerate(sizes)]
    broken = transport.cells(spark.createDataFrame([("f", b"\x00" * 188 + b"\x47" * 100)], "path string, content binary")).collect()
    assert [r["error"] for r in broken] == ["Invalid"]


def test_sound_headers_agree(spark):
    row = spark.range(1).select(media.adts_header(F.lit(50), 48_000, 2).alias("h")).first()
    assert bytes(row["h"]) == adts(b"x" * 50)[:7]


def plan_of(spark, data, name):
    return QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_pictures_come_from_one_pass_each(spark, data):
    """Facts and bytes of pictures are two passes over the events; their numbers need no join of the events with themselves."""
    assert plan_of(spark, data, "transport_pictures").count("Relation [") == 2


def test_cells_make_packets_once(spark, data):
    """The cells that name the streams come from the same packets as the others."""
    assert plan_of(spark, data, "transport_cells").count("ArrowEvalPython") == 1


def test_carry_tables_only_where_asked(spark):
    """A track of one block needs no table of all 184 states."""
    df = spark.createDataFrame([("f", 0, 0, 0, True, MARK + b"\x65x")], "path string, idx long, pts long, dts long, keyframe boolean, content binary")
    plan = transport.carries(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(__block" in plan


@pytest.mark.parametrize("name", ["transport_streams", "transport_round_trip"])
def test_streams_are_read_from_written_files(spark, data, name):
    """What reads files finds them, or their packets, in a table, instead of making them for each use."""
    plan = plan_of(spark, data, name)
    assert "event_type" not in plan and "Relation [" in plan


# ---------------------------------------------------------------- files and captions

def test_header_reads_no_payload(spark):
    df = spark.range(3).selectExpr("1L as track_id", "'video' as type", "id as idx", "id * 10 as pts", "id * 10 as dts", "5L as size", "id = 0 as keyframe", "1000L as timescale", "cast('aaaaa' as binary) as content", "cast('x' as binary) as heavy")
    df.write.mode("overwrite").parquet(folder := f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/payload-test")
    read = spark.read.parquet(folder)
    plan = mp4.whole(read, "header")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in "".join(x for x in plan.splitlines() if "ReadSchema" in x)
    whole, head, body = (bytes(mp4.whole(read, f).first()["content"]) for f in ("regular", "header", "samples"))
    assert whole == head + body and len(body) == 15
    with pytest.raises(ValueError, match="InvalidArguments"):
        mp4.whole(read, "other")
    with pytest.raises(Exception, match="go on"):
        mp4.whole(read.withColumn("dts", F.lit(1).cast("long"))).collect()


def test_boxes_are_read_where_bytes_lie(spark):
    """No file is copied to be looked at, and none, empty and broken ones have no boxes."""
    box = lambda kind, b=b"": (8 + len(b)).to_bytes(4, "big") + kind + b
    rows = [(0, box(b"ftyp", b"isom") + box(b"moov", box(b"trak"))), (1, None), (2, b""), (3, b"\x00\x00\x00\xffmoov"), (4, box(b"\xa9abc"))]
    found = {r["i"]: [tuple(b) for b in r["boxes"]] for r in readers.mp4_boxes(spark.createDataFrame(rows, "i int, content binary")).collect()}
    assert found == {0: [("ftyp", 0, 12, 0), ("moov", 12, 16, 0), ("trak", 20, 8, 1)], 1: [], 2: [], 3: [], 4: [("\xa9abc", 0, 8, 0)]}
    kept = memoryview(rows[0][1])
    assert list(readers.boxes_of(kept)) == list(readers.boxes_of(rows[0][1]))


def test_captions_are_cut(spark):
    unit = lambda b: len(b).to_bytes(4, "big") + b
    caption, slice_, broken = unit(b"\x06\x04\x02hi\x80"), unit(b"\x41abc"), unit(b"\x06\x04\xff\xff")
    rows = [(0, caption + slice_), (1, slice_), (2, broken + slice_), (3, None), (4, b""), (5, slice_ + caption), (6, caption)]
    df = spark.createDataFrame(rows, "idx long, content binary")
    found = {r["idx"]: (r["picture"] and bytes(r["picture"]), r["caption"] and bytes(r["caption"])) for r in captions.split(df).collect()}
    assert found[0] == found[5] == (slice_, caption) and found[1] == (slice_, b"") and found[2] == (broken + slice_, None)
    assert found[3][0] is None and found[4][0] == b"" and found[6] == (b"", caption)
