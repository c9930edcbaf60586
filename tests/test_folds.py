"""Queries that have no SQL, over their whole tables, against plain loops."""

import collections

import numpy as np

from trackloom.operators.transforms import ADTS_BYTES
from trackloom.plans.catalog import QUERIES
from trackloom.plans.image_queries import pixels
from trackloom.sources import views


def tracks_of(df, *columns):
    found = collections.defaultdict(list)
    for r in df.select("track_id", "idx", *columns).orderBy("track_id", "idx").collect():
        found[r["track_id"]].append((r["idx"], *(r[c] for c in columns)))
    return found


def test_remove_overlap_fold(spark, data):
    kept = set()
    for t, rows in tracks_of(views.samples(spark, data), "pts", "dts").items():
        last = None
        for i, p, d in rows[::-1]:
            if last is None or (p < last[0] and d < last[1]):
                last = p, d
                kept.add((t, i))
    assert {(r["track_id"], r["idx"]) for r in QUERIES["remove_overlap_fold"](spark, data).collect()} == kept


def test_unique_pts_repair(spark, data):
    expected = {}
    for t, rows in tracks_of(views.coarse(spark, data), "pts", "dts").items():
        seen_p, seen_d = [], []
        for i, p, d in rows:
            while p in seen_p or d in seen_d:
                p, d = p + 1, d + 1
            for seen, x in ((seen_p, p), (seen_d, d)):
                if len(seen) >= 16:
                    seen.remove(min(seen))
                seen.append(x)
            expected[t, i] = p, d
    assert {(r["track_id"], r["idx"]): (r["pts"], r["dts"]) for r in QUERIES["unique_pts_repair"](spark, data).collect()} == expected


def test_adts_packing(spark, data):
    expected = {}
    for t, rows in tracks_of(views.samples(spark, data).where("type = 'audio'"), "pts", "dts", "size").items():
        packet, used, count, first = -1, 0, 0, None
        for i, p, d, size in rows:
            p, d = p * 90000 // 1_000_000, d * 90000 // 1_000_000
            guess = 90000 * count * 1024 // 44_100
            if first is None or used + size + 7 > ADTS_BYTES or max(abs(first[0] + guess - p), abs(first[1] + guess - d)) > 10:
                packet, used, count, first = packet + 1, 0, 0, (p, d)
            used, count = used + size + 7, count + 1
            expected[t, i] = packet
    assert {(r["track_id"], r["idx"]): r["packet"] for r in QUERIES["adts_packing"](spark, data).collect()} == expected


def test_work_parts(spark, data):
    expected = set()
    for t, rows in tracks_of(views.samples(spark, data).where("type = 'video'"), "dts", "keyframe").items():
        final = rows[-1][1]
        share, begin, part, held = (final + 1) // 3, 0, 0, []
        for _, d, k in rows:
            if k and d > begin + share and d != final:
                expected |= {(t, part, held[0], held[-1], len(held))} if held else set()
                part, begin, held = part + 1, d, []
            held.append(d)
        expected.add((t, part, held[0], held[-1], len(held)))
    found = {(r["track_id"], r["part"], r["first_dts"], r["last_dts"], r["n"]) for r in QUERIES["work_parts"](spark, data).collect()}
    assert {f[:1] + f[2:] for f in found} == {e[:1] + e[2:] for e in expected}


def test_palette_nearest(spark, data):
    held = collections.defaultdict(list)
    for r in pixels(spark, data).collect():
        held[r["label"]].append((r["frame_id"], r["i"], r["r"], r["g"], r["b"]))
    found = {(r["frame_id"], r["i"]): (r["label"], r["n"]) for r in QUERIES["palette_nearest"](spark, data).collect()}
    assert len(found) == sum(map(len, held.values()))
    for label, rows in held.items():
        x = np.array([r[2:] for r in rows], float)
        near = np.array([found[r[:2]][1] for r in rows])
        assert {found[r[:2]][0] for r in rows} == {label} and len(set(near)) == 4
        # Converged: each pixel is with the nearest of the means of the pixels that are with each.
        centres = np.array([x[near == n].mean(0) for n in range(4)])
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert (d[np.arange(len(x)), near] <= d.min(1) + 1e-6).all()
