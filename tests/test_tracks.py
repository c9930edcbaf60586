"""Track semantics against plain scalar models on random small inputs, and the edge cases by hand."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trackloom.functions import arith, media, octets
from trackloom.operators import compare, containers, editboxes, images, stitching, tools, track, transforms
from trackloom.sources import mp4, readers

SAMPLE = "track_id long, idx long, pts long, dts long, timescale long, keyframe boolean, type string, size int"
BOX = "track_id long, ord int, start_pts long, duration_pts long"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def tracks(spark, rows):
    return spark.createDataFrame(rows, SAMPLE)


def model_real(boxes, pts):
    if not boxes:
        return pts
    played = 0
    for start, size in boxes:
        if start == -1:
            played = size
        elif start <= pts < start + size:
            return played + pts - start
        elif pts > start + size:
            played += size
        else:
            break
    return -1


def model_trim(boxes, start, size):
    boxes, lead = list(boxes), 0
    if boxes and boxes[0][0] == -1:
        lead = boxes.pop(0)[1]
    if start >= lead:
        start, lead = start - lead, 0
    elif start + size > lead:
        lead, start = lead - start, 0
        size -= lead
    else:
        return []
    out = []
    if not boxes:
        out = [(start, size)]
    else:
        skip, left = start, size
        for a, n in boxes:
            if skip >= n:
                skip -= n
                continue
            take = min(n - skip, left)
            out.append((a + skip, take))
            skip, left = 0, left - take
            if not left:
                break
    return ([(-1, lead)] if lead else []) + out


def random_boxes(rng):
    at, out = 0, []
    if rng.random() < 0.4:
        out.append((-1, rng.randint(1, 6)))
    for _ in range(rng.randint(1, 4)):
        at += rng.choice([0, 0, 1, 3])
        n = rng.randint(1, 5)
        out.append((at, n))
        at += n
    return out


def test_real_pts_and_trim(spark):
    rng = random.Random(5)
    cases = [(i, random_boxes(rng), rng.randint(0, 25), rng.randint(0, 20), rng.randint(1, 20)) for i in range(400)]
    df = spark.createDataFrame([(i, [{"start": a, "duration": n} for a, n in b], p, s, d) for i, b, p, s, d in cases], f"i long, boxes {editboxes.BOXES}, pts long, s long, d long")
    found = df.select("i", editboxes.real_pts(F.col("boxes"), F.col("pts")).alias("real"), editboxes.trimmed(F.col("boxes"), F.col("s"), F.col("d")).alias("cut"), editboxes.valid(F.col("boxes")).alias("ok"))
    by = {r["i"]: r for r in found.collect()}
    for i, boxes, pts, s, d in cases:
        assert by[i]["real"] == model_real(boxes, pts), (boxes, pts)
        assert [(b["start"], b["duration"]) for b in by[i]["cut"]] == model_trim(boxes, s, d), (boxes, s, d)
        assert by[i]["ok"]


def test_abutting_boxes_and_empty_ones(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 10)], BOX)
    rows = tracks(spark, [(1, i, p, p, 1, True, "video", 1) for i, p in enumerate((9, 10, 11))] + [(2, 0, 7, 7, 1, True, "video", 1)])
    found = {(r["track_id"], r["pts"]): r["real_pts"] for r in editboxes.with_real_pts(rows, boxes).collect()}
    assert found == {(1, 9): 9, (1, 10): -1, (1, 11): 11, (2, 7): 7}
    lone = spark.createDataFrame([([{"start": -1, "duration": 5}],), ([{"start": 0, "duration": 5}, {"start": -1, "duration": 5}],), ([{"start": 0, "duration": 5}, {"start": 4, "duration": 5}],)], f"boxes {editboxes.BOXES}")
    assert [r["v"] for r in lone.select(editboxes.valid(F.col("boxes")).alias("v")).collect()] == [False, False, False]


def test_unique_times_against_a_model(spark):
    rng = random.Random(9)
    rows, expected = [], {}
    for t in range(40):
        at, seq = 0, []
        for i in range(rng.randint(1, 30)):
            at += rng.choice([0, 1, 2, 5]) if rng.random() < 0.9 else rng.choice([0, 1, 2, 3])
            seq.append((at, at + rng.choice([0, 0, 1])))
        seen_p, seen_d, out, bumps = set(), set(), [], 0
        for d, p in seq:
            while p in seen_p or d in seen_d:
                p, d, bumps = p + 1, d + 1, bumps + 1
            for seen in (seen_p, seen_d):
                if len(seen) >= 16:
                    seen.remove(min(seen))
            seen_p.add(p)
            seen_d.add(d)
            out.append((p, d))
        if bumps > 32:
            continue
        expected[t] = out
        rows += [(t, i, p, d, 1, False, "video", 1) for i, (d, p) in enumerate(seq)]
    found = {}
    for r in transforms.unique_times(tracks(spark, rows)).orderBy("track_id", "idx").collect():
        found.setdefault(r["track_id"], []).append((r["pts"], r["dts"]))
    assert found == expected
    with pytest.raises(Exception, match="Unsafe"):
        transforms.unique_times(tracks(spark, [(1, i, 0, 0, 1, False, "video", 1) for i in range(12)])).collect()


def test_overlap_fold_differs_from_suffix_minimum(spark):
    rows = [(1, 0, 5, 0, 1, False, "audio", 1), (1, 1, 9, 3, 1, False, "audio", 1), (1, 2, 4, 6, 1, False, "audio", 1), (1, 3, 8, 7, 1, False, "audio", 1)]
    kept = [r["idx"] for r in transforms.without_overlap_fold(tracks(spark, rows)).orderBy("idx").collect()]
    assert kept == [2, 3]
    even = [(1, i, d, d, 1, False, "audio", 1) for i, d in enumerate((0, 4, 2, 3))]
    assert [r["idx"] for r in transforms.without_overlap(tracks(spark, even)).orderBy("idx").collect()] == [r["idx"] for r in transforms.without_overlap_fold(tracks(spark, even)).orderBy("idx").collect()] == [0, 2, 3]


def test_folds_hold_no_whole_track(spark):
    """Tracks of many batches and batches of many tracks give what the whole track gives, and no group is loaded as one table."""
    rows = [(t, i, 20 * i + (i % 7), 20 * i + (i % 5), 1, False, "audio", 600 + i % 11) for t in range(5) for i in range(100 if t == 3 else 4)]
    rows += [(9, i, i // 2 * 40, i // 2 * 40, 1, False, "audio", 900) for i in range(60)]
    df = tracks(spark, rows)
    kept, packets = set(), {}
    for t in {r[0] for r in rows}:
        mine, last = [r for r in rows if r[0] == t], None
        for r in mine[::-1]:
            if last is None or (r[2] < last[2] and r[3] < last[3]):
                last = r
                kept.add(r[:2])
        packet, used, count, first = -1, 0, 0, None
        for r in mine:
            guess = 90000 * count * 1024 // 44_100
            if first is None or used + r[7] + 7 > 3661 or abs(first[2] + guess - r[2]) > 10 or abs(first[3] + guess - r[3]) > 10:
                packet, used, count, first = packet + 1, 0, 0, r
            used, count = used + r[7] + 7, count + 1
            packets[r[:2]] = packet
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        folds = [transforms.without_overlap_fold(df), transforms.packed_adts(df, 44_100), transforms.unique_times(df)]
        assert all("FlatMapGroups" not in f._jdf.queryExecution().toString() for f in folds)
        assert {(r["track_id"], r["idx"]) for r in folds[0].collect()} == kept
        assert {(r["track_id"], r["idx"]): r["packet"] for r in folds[1].collect()} == packets
        found = {(r["track_id"], r["idx"]): (r["pts"], r["dts"]) for r in folds[2].collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {r[:2]: (r[2] + r[1] % 2, r[3] + r[1] % 2) if r[0] == 9 else (r[2], r[3]) for r in rows}


def test_interleave_puts_video_first_on_ties(spark):
    rows = [(1, 0, 0, 90, 90, True, "video", 1), (1, 1, 0, 0, 44100, False, "audio", 1), (1, 2, 0, 44100, 44100, False, "audio", 1)]
    assert [r["idx"] for r in transforms.interleaved(tracks(spark, rows)).orderBy("pos").collect()] == [1, 0, 2]


def test_interleave_against_a_merge(spark):
    """Also where decode times fall: sound goes on while it is before the next picture, and each kind keeps its order."""
    rng = random.Random(7)
    rows, expected = [], {}
    for t in range(40):
        seq = [(rng.choice(["video", "audio", "data"]), rng.randint(0, 12)) for _ in range(rng.randint(1, 14))]
        rows += [(t, i, 0, d, 1, False, kind, 1) for i, (kind, d) in enumerate(seq)]
        video, audio, out = [(i, d) for i, (k, d) in enumerate(seq) if k == "video"], [(i, d) for i, (k, d) in enumerate(seq) if k == "audio"], []
        for i, d in video:
            while audio and audio[0][1] < d:
                out.append(audio.pop(0)[0])
            out.append(i)
        expected[t] = out + [i for i, _ in audio]
    found = {}
    for r in transforms.interleaved(tracks(spark, rows)).orderBy("track_id", "pos").collect():
        found.setdefault(r["track_id"], []).append(r["idx"])
    assert found == {t: o for t, o in expected.items() if o}
    odd = transforms.interleaved(tracks(spark, [(1, 0, 0, 5, 1, True, "video", 1), (1, 1, 0, 3, 1, True, "video", 1), (1, 2, 0, 4, 1, True, "audio", 1)]))
    assert [(r["idx"], r["nth"]) for r in odd.orderBy("pos").collect()] == [(2, 0), (0, 0), (1, 1)]


def test_trim_without_boxes_and_limits(spark):
    rows = [(1, i, 10 * i, 10 * i, 1000, i % 4 == 0, "video", 1) for i in range(12)] + [(2, i, 10 * i, 10 * i, 1000, i == 5, "video", 1) for i in range(6)]
    out, boxes, _ = transforms.trim(tracks(spark, rows), None, 45, 30)
    assert [(r["track_id"], r["idx"], r["pts"], r["keyframe"]) for r in out.orderBy("track_id", "idx").collect()][:4] == [(1, 0, 0, True), (1, 1, 10, False), (1, 2, 20, False), (1, 3, 30, False)]
    assert [(r["track_id"], r["start_pts"], r["duration_pts"]) for r in boxes.collect() if r["track_id"] == 1] == [(1, 5, 30)]


def model_duration(dts):
    steps = sorted(b - a for a, b in zip(dts, dts[1:]))
    half = len(steps) // 2
    median = 0 if not steps else steps[half] if len(steps) % 2 else (steps[half - 1] + steps[half]) // 2
    return None if steps and steps[0] < 0 else dts[-1] - dts[0] + median


def test_trim_errors_against_a_model(spark):
    rng = random.Random(11)
    rows, boxes, expected = [], [], {}
    for t in range(120):
        dts, at = [], rng.choice([0, 0, 5])
        for _ in range(rng.randint(1, 12)):
            dts.append(at)
            at += rng.choice([0, 1, 2, 3, -1 if t % 9 == 0 else 2])
        seq = [(max(0, d + rng.choice([0, 0, 1, -1 if t % 4 == 0 else 2])), d, rng.random() < 0.5) for d in map(lambda d: max(d, 0), dts)]
        rows += [(t, i, p, d, 1000, k, "video", 1) for i, (p, d, k) in enumerate(seq)]
        listed = random_boxes(rng) if t % 2 else []
        if t % 10 == 1:
            listed = [(4, 5), (2, 3)]
        boxes += [(t, i, a, n) for i, (a, n) in enumerate(listed)]
        start, size, error, out = 3, 6, None, []
        whole = model_duration([d for _, d, _ in seq])
        if t % 10 == 1 or (not listed and not whole):
            expected[t] = ([], "Invalid")
            continue
        cut = [b for b in model_trim(listed, start, size if listed else min(size, whole)) if b[0] != -1]
        low, high = min((a for a, n in cut), default=0), max((a + n for a, n in cut), default=0)
        key = first = last = -1
        for i, (p, d, k) in enumerate(seq):
            if low >= high:
                break
            if k and key < 0:
                if first >= 0:
                    error = "Invalid"
                    break
                key = i
            elif k and first < 0 and p <= low:
                key = i
            if first < 0 and p >= low:
                first = i
            if p < high:
                last = i
        if not error and 0 <= key <= first <= last:
            base = seq[key][1]
            out = [(i - key, p - base, d - base) for i, (p, d, _) in enumerate(seq) if key <= i <= last]
            error = "Unsupported" if base > low else None if model_duration([d for _, _, d in out]) else "Invalid"
        expected[t] = ([] if error else out, error)
    found = {t: [] for t in expected}
    out, _, summary = transforms.trim(tracks(spark, rows), spark.createDataFrame(boxes, BOX), 3, 6)
    for r in out.orderBy("track_id", "idx").collect():
        found[r["track_id"]].append((r["idx"], r["pts"], r["dts"]))
    errors = {r["track_id"]: r["error_category"] for r in summary.collect()}
    assert {t: (found[t], errors[t]) for t in expected} == expected
    assert {e for _, e in expected.values()} == {None, "Invalid", "Unsupported"}


def test_stitch_against_a_model(spark):
    """Audio and video gaps, timescales, boxes that some files lack, sound that overlaps, and the errors."""
    rng = random.Random(13)
    rows, boxes, expected = [], [], {}
    for t in range(60):
        files, error = [], None
        for f in range(rng.randint(1, 3)):
            scale = rng.choice([30, 60])
            at, video = rng.choice([0, 2]), []
            for _ in range(1 if t % 12 == 5 and f else rng.randint(2, 5)):
                video.append(at)
                at += rng.choice([1, 2, 3])
            at, audio = rng.choice([0, 1, 9]), []
            for _ in range(0 if t % 12 == 7 and f else rng.randint(1, 6)):
                audio.append(at)
                at += rng.choice([2, 5, 9])
            vb = [(video[0], 3), (video[0] + 4, 2)] if t % 2 and rng.random() < 0.6 else []
            ab = [(audio[0], 4)] if audio and t % 3 == 0 and rng.random() < 0.5 else []
            files.append((scale, video, audio, vb, ab))
            i = 0
            for d in video:
                rows.append((t, f, i, d, d, scale, True, "video", 1))
                i += 1
            for d in audio:
                rows.append((t, f, i, d, d + 1, 100, True, "audio", 1))
                i += 1
            boxes += [(t, f, o, a, n, "video") for o, (a, n) in enumerate(vb)] + [(t, f, o, a, n, "audio") for o, (a, n) in enumerate(ab)]
        s = files[0][0]
        to = lambda x, k: (x * s + k // 2) // k
        sound = lambda x: (x * 100 + s // 2) // s
        vd = ad = 0
        has_audio, has_boxes = any(a for _, _, a, _, _ in files), any(vb or ab for *_, vb, ab in files)
        out_v, out_a, box_v, box_a = [], [], [], []
        for k, video, audio, vb, ab in files:
            video, vb = [to(x, k) if k != s else x for x in video], [(to(a, k), to(n, k)) if k != s else (a, n) for a, n in vb]
            if (has_audio and not audio) or (len(video) == 1):
                error = "InvalidArguments" if has_audio and not audio else "Unsupported"
                break
            own = model_duration(video)
            vo = vd - video[0]
            out_v += [x + vo for x in video]
            box_v += [(a + vo, n) for a, n in vb] or [(video[0] + vo, own)]
            vd += own
            counted = model_duration(audio) if ab else sound(sum(n for _, n in vb)) if vb else sound(own)
            gap = audio[0] + 1 - sound(video[0])
            ao = ad - (audio[0] + 1) + gap
            out_a += [(x + ao, x + 1 + ao) for x in audio if not (ao < 0 and -ao > x and -ao > x + 1)]
            box_a += [(a + ao, n) for a, n in ab] or [(audio[0] + 1 + ao, counted)]
            ad += counted
        kept = []
        for p, d in out_a[::-1]:
            if not kept or (p < kept[-1][0] and d < kept[-1][1]):
                kept.append((p, d))
        expected[t] = ([], [], [], error) if error else (out_v, kept[::-1], (box_v + box_a) if has_boxes else [], None)
    df = spark.createDataFrame(rows, "track_id long, file_ord int, idx long, pts long, dts long, timescale long, keyframe boolean, type string, size int")
    listed = spark.createDataFrame(boxes, "track_id long, file_ord int, ord int, start_pts long, duration_pts long, type string")
    out, new_boxes, summary = stitching.stitched_files(df, listed)
    found = {t: ([], [], [], None) for t in expected}
    for r in out.orderBy("track_id", "type", "idx").collect():
        found[r["track_id"]][0 if r["type"] == "video" else 1].append(r["dts"] if r["type"] == "video" else (r["pts"], r["dts"]))
    for r in new_boxes.orderBy("track_id", "ord").collect():
        found[r["track_id"]][2].append((r["start_pts"], r["duration_pts"]))
    for r in summary.collect():
        found[r["track_id"]] = (*found[r["track_id"]][:3], r["error_category"])
    assert found == expected and {e for *_, e in expected.values()} == {None, "InvalidArguments", "Unsupported"}


def test_long_tracks_take_linear_time(spark):
    """A track of a hundred thousand rows: each row costs the same wherever it stands."""
    rows = spark.range(100_000).selectExpr("1L as track_id", "id as idx", "id * 10 as pts", "id * 10 + id % 7 as dts", "1L as timescale", "id % 50 = 0 as keyframe", "if(id % 400 = 399, 'caption', 'video') as type", "1 as size").cache()
    rows.count()
    began = time.monotonic()
    found = compare.captions_ahead(rows.where("type = 'video'"), rows.where("type = 'caption'"))
    assert found.where("caption_idx is null or caption_idx < idx").count() == 0
    assert transforms.without_overlap(rows, 4096).count() == transforms.without_overlap(rows).count() == 100_000
    falling = rows.withColumn("dts", F.expr("if(idx % 1000 = 999, dts - 5000, dts)"))
    assert transforms.without_overlap(falling, 4096).select("idx").exceptAll(transforms.without_overlap(falling).select("idx")).count() == 0
    assert time.monotonic() - began < 60


def test_rules_of_files(spark):
    rows = tracks(spark, [(1, i, p, d, 1, k, "video", 1) for i, (p, d, k) in enumerate([(0, 0, True), (2, 1, True), (1, 2, True), (3, 3, True)])])
    assert [r["keyframe"] for r in containers.open_gops(rows).orderBy("idx").collect()] == [True, False, False, True]
    same = tracks(spark, [(1, i, 4, 4, 1, True, "video", 1) for i in range(3)])
    assert all(r["keyframe"] for r in containers.open_gops(same).collect())
    assert [r["idx"] for r in track.thumbnails(rows, 1).collect()] == [0] and [r["idx"] for r in track.thumbnails(rows, 2).orderBy("idx").collect()] == [0, 3]
    sizes = [50, 100, 150, 250, 300]
    assert [value(spark, arith.padding(F.lit(n), [100])) for n in sizes] == [50, 0, 0, 0, 0] and value(spark, arith.padding(F.lit(7), [])) == 0
    assert [value(spark, octets.output_kind(F.lit(p))) for p in ("a.mov", "a.m4v", "a.ts.x", "b.webm", "b")] == ["mp4", "mp4", "mp2ts", "webm", "unknown"]
    assert transforms.ADTS_BYTES == 3661
    fall = [r.asDict() for r in transforms.durations(tracks(spark, [(1, 0, 0, 5, 1, True, "video", 1), (1, 1, 0, 3, 1, True, "video", 1)])).collect()]
    assert fall == [{"track_id": 1, "duration": None, "error_category": "Invalid"}]
    with pytest.raises(Exception, match="Unsupported"):
        editboxes.written(spark.createDataFrame([(1, 0, 0, 5, "caption")], BOX + ", type string"), spark.createDataFrame([(1, "caption", 1, 1)], "track_id long, type string, timescale long, movie_timescale long")).collect()
    with pytest.raises(ValueError, match="Unsupported"):
        editboxes.written(None, None, "dash")


def test_work_is_cut_at_keyframes(spark):
    rows = tracks(spark, [(1, i, 10 * i, 10 * i, 1, i % 4 == 0, "video", 1) for i in range(30)])
    parts = [(r["part"], r["first_dts"], r["last_dts"]) for r in tools.work_parts(rows, 3).orderBy("part").collect()]
    assert parts == [(0, 0, 110), (1, 120, 230), (2, 240, 290)]


def test_chunks_join_back_and_shift_inverts(spark):
    rows = tracks(spark, [(1, i, i, i, 1, i % 3 == 0, "video", i) for i in range(9)])
    cut = track.with_gop(rows)
    parts = [cut.where(F.col("gop") == g).select(rows.columns) for g in (1, 2, 3)]
    assert track.concatenated(parts).select(rows.columns).orderBy("idx").collect() == rows.orderBy("idx").collect()
    k = F.lit(7).cast("long")
    assert track.shifted(track.shifted(rows, k), -k).orderBy("idx").collect() == rows.orderBy("idx").collect()
    with pytest.raises(Exception, match="below zero"):
        track.shifted(rows, -k).collect()


def test_running_sum_in_blocks_is_the_same(spark):
    rows = tracks(spark, [(t, i, i, i, 1, (i * 7 + t) % 5 == 0, "video", 1) for t in (1, 2) for i in range(50)])
    assert sorted(track.with_gop(rows, 8).collect()) == sorted(track.with_gop(rows).collect())


def test_rounding(spark):
    assert value(spark, arith.round_divide(F.lit(1), 1, 3)) == 0
    assert value(spark, arith.round_divide(F.lit(5), 1, 2)) == 3
    assert value(spark, arith.ceil_divide(F.lit(5), 1, 2)) == 3
    assert value(spark, arith.align_shift(F.lit(17), 4)) == 32
    assert [value(spark, arith.padding(F.lit(n), [100, 200])) for n in (50, 100, 150, 250, 300)] == [50, 0, 50, 50, 0]
    medians = spark.createDataFrame([(0, None), (1, 1), (1, 2), (2, 1), (2, 2), (2, 4)], "k int, v long").groupBy("k").agg(arith.whole_median("v").alias("m"))
    assert {r["k"]: r["m"] for r in medians.collect()} == {0: 0, 1: 1, 2: 2}
    assert value(spark, arith.repaired_offset(F.lit(4294967295).cast("long"))) == -1


def test_sound(spark):
    assert value(spark, containers.mono(F.array(F.lit(30000), F.lit(30000), F.lit(-5), F.lit(2)))) == [32767, -3]
    assert value(spark, containers.halved(F.array(F.lit(3), F.lit(4), F.lit(-3), F.lit(-4)))) == [3, -3]
    rows = tracks(spark, [(1, i, i, i, 1, False, "audio", n) for i, n in enumerate((60, 40, 50, 60))])
    assert [(r["sound"], r["straddles"]) for r in containers.packed_sounds(rows, 100).orderBy("idx").collect()] == [(0, False), (0, False), (1, False), (2, True)]


def test_nal_units_round_trip(spark):
    a, b = bytes([0x67, 1, 2]), bytes([0x65, 9, 9, 9])
    annexb = b"\x00\x00\x00\x01" + a + b"\x00\x00\x01" + b
    assert [(u["type"], u["size"], u["prefix"]) for u in octets.annexb_units(annexb)] == [(7, 3, 4), (5, 4, 3)]
    df = spark.createDataFrame([(annexb,), (b"",), (None,)], "x binary")
    back = df.select(octets.convert_nals(octets.convert_nals(F.col("x"), "avcc"), "annexb").alias("y")).collect()
    assert bytes(back[0]["y"]) == b"\x00\x00\x00\x01" + a + b"\x00\x00\x00\x01" + b and bytes(back[1]["y"]) == b"" and back[2]["y"] is None
    assert value(spark, octets.nal_type(F.lit(bytearray([0xAA])))) == 10
    assert value(spark, octets.bits(F.lit(bytearray([0b10110011, 0b01000000])), 2, 8)) == 0b11001101


def test_captions_ahead_and_diff(spark):
    video = tracks(spark, [(1, i, p, p, 1, True, "video", 1) for i, p in enumerate((0, 5, 9))])
    captions = tracks(spark, [(1, 0, 5, 5, 1, False, "caption", 1), (1, 1, 6, 6, 1, False, "caption", 1)])
    assert [r["caption_idx"] for r in compare.captions_ahead(video, captions).orderBy("idx").collect()] == [0, 0, None]
    assert compare.positional_diff(video, video, ["pts"], ["idx"]).count() == 0
    assert compare.positional_diff(video, captions, ["pts"], ["idx"]).count() == 3


def test_file_scan_and_boxes(spark, tmp_path):
    box = lambda kind, body=b"": (8 + len(body)).to_bytes(4, "big") + kind + body
    (tmp_path / "a.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"tkhd", b"xx"))))
    (tmp_path / "b.png").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    found = readers.scan(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[-1]: r["kind"] for r in found.select("path", "kind").collect()} == {"a.mp4": "mp4", "b.png": "png"}
    boxes = readers.mp4_boxes(found.where("kind = 'mp4'")).first()["boxes"]
    assert [(b["type"], b["depth"]) for b in boxes] == [("ftyp", 0), ("moov", 0), ("trak", 1), ("tkhd", 2)]
    with pytest.raises(readers.MissingDependency):
        readers.codec("h264")
    readers.register_codec("raw", "decode", bytes)
    assert readers.codec("raw")(b"x") == b"x"


def test_empty_tracks(spark):
    none = tracks(spark, [])
    assert track.with_gop(none).count() == transforms.interleaved(none).count() == transforms.unique_times(none).count() == compare.validated(none).count() == 0


def test_means_against_plain_rounds(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.randrange(40)), float(rng.randrange(40))) for k in "ab" for _ in range(30)] + [("c", 1.0, 2.0)] * 5
    expected = {}
    for k in "abc":
        points = [p[1:] for p in rows if p[0] == k]
        colours = sorted(set(points))
        m = min(3, len(colours))
        centres = [colours[i * (len(colours) - 1) // max(m - 1, 1)] for i in range(m)]
        for _ in range(100):
            near = [min(range(m), key=lambda n: (sum((a - b) ** 2 for a, b in zip(p, centres[n])), n)) for p in points]
            moved = [tuple(sum(c) / len(own) for c in zip(*own)) if (own := [p for p, n in zip(points, near) if n == i]) else centres[i] for i in range(m)]
            if max(abs(a - b) for x, y in zip(moved, centres) for a, b in zip(x, y)) <= 1e-8:
                break
            centres = moved
        expected[k] = [tuple(round(x, 6) for x in c) for c in moved]
    found = {}
    for r in images.means(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], ["x", "y"], 3).orderBy("k", "n").collect():
        found.setdefault(r["k"], []).append((round(r["x"], 6), round(r["y"], 6)))
    assert found == expected


def test_single_precision_stays_single(spark):
    """351970315620 ticks are 351970.34375 s in single precision, but 351970.3125 s if only the quotient is rounded."""
    df = spark.createDataFrame([(351970315620, 1_000_000)], "t long, s long")
    assert df.select(arith.seconds(F.col("t"), F.col("s")).cast("double").alias("x")).first()["x"] == 351970.34375


def test_sound_headers(spark):
    head = media.adts_header(F.lit(20), 44_100, 2)
    frame = F.concat(head, F.unhex(F.lit("00" * 20)))
    assert value(spark, media.adts(frame)).asDict() == {"codec": "aac_lc", "sample_rate": 44100, "channels": 2, "header_size": 7, "data_size": 20, "error": None}
    assert value(spark, media.adts(F.substring(frame, 1, 26))) is None and value(spark, media.adts(F.substring(frame, 1, 5))) is None
    assert value(spark, media.adts(F.unhex(F.lit("0" * 40))))["error"] == "Invalid"
    assert value(spark, media.audio_config(F.unhex(F.lit("12100000000000")))).asDict() == {"object_type": 2, "sample_rate": 44100, "channels": 2}
    assert value(spark, containers.decoded_pcm(F.unhex(F.lit("0080FF7F01")))) == [-32768, 32767]
    assert value(spark, containers.decoded_pcm(F.unhex(F.lit("AA8000BB0100")), 24)) == [128, 1]


def test_caption_messages(spark):
    long = bytes([4, 255, 10]) + b"x" * 265
    unit = bytes([6, 1, 2, 7, 7]) + long + bytes([5, 1, 9, 0x80])
    assert octets.sei_messages(unit) == ([(1, 1, 4), (4, 5, 268), (5, 273, 3)], True)
    kept = bytes([6, 4, 5, 1, 0, 0, 3, 1, 9, 0x80])
    assert octets.sei_messages(kept) == ([(4, 1, 8)], True)
    assert octets.sei_messages(bytes([6, 4, 9, 1])) == ([], False) and octets.sei_messages(bytes([6, 255, 255]))[1] is False
    df = spark.createDataFrame([(unit,), (bytes([6, 1, 1, 7, 0x80]),), (bytes([6, 4, 9, 1]),), (None,)], "x binary")
    out = [None if r["y"] is None else bytes(r["y"]) for r in df.select(octets.captions(F.col("x")).alias("y")).collect()]
    assert out == [(270).to_bytes(4, "big") + bytes([6]) + long + bytes([0x80]), b"", None, None]


def test_sample_tables_by_hand(spark):
    """A file as others write it: runs in its tables, fixed sizes, chunks of different lengths, no table of keyframes, offsets that are negative."""
    n = lambda x, size=4: x.to_bytes(size, "big")
    box = lambda kind, body=b"": n(8 + len(body)) + kind + body
    table = lambda kind, *rows: box(kind, n(0) + n(len(rows)) + b"".join(n(v % (1 << 32)) for r in rows for v in r))
    stbl = box(b"stbl", table(b"stts", (3, 10), (3, 20)) + table(b"ctts", (1, 0), (1, -5), (4, 7)) + box(b"stsz", n(0) + n(4) + n(6)) + table(b"stsc", (1, 2, 1), (3, 1, 1)) + table(b"stco", (100,), (200,), (300,), (400,)))
    trak = box(b"trak", box(b"mdia", box(b"mdhd", n(0) * 3 + n(600) + n(0) * 2) + box(b"hdlr", n(0) * 2 + b"soun" + n(0) * 3 + b"x") + box(b"minf", stbl)))
    df = spark.createDataFrame([("a", box(b"ftyp", b"isom") + box(b"moov", trak + box(b"trak"))), ("b", b""), ("c", b"xx")], "path string, content binary")
    found = [(r["path"], r["type"], r["timescale"], r["idx"], r["pts"], r["dts"], r["keyframe"], r["pos"], r["size"]) for r in mp4.sample_tables(df).orderBy("idx").collect()]
    expected = zip((0, 10, 20, 30, 50, 70), (0, -5, 7, 7, 7, 7), (100, 104, 200, 204, 300, 400))
    assert found == [("a", "audio", 600, i, d + o, d, True, at, 4) for i, (d, o, at) in enumerate(expected)]


def test_exchanges_of_stitching_and_trimming(spark, data):
    """Facts are found once; what is made of them meets the samples in a few exchanges."""
    from trackloom.plans.catalog import QUERIES

    for name in ("stitch_av", "trim_track"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert sum(plan.count(x) for x in ("Exchange hashpartitioning", "Exchange SinglePartition", "BroadcastExchange")) <= 8
