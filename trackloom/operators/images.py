"""Images as planes: crop, rotate, gravity, histograms, palettes, resampling weights, lookup tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.arith import div
from trackloom.functions.colour import byte_to_unit, hsv, lab
from trackloom.sources.tables import discard, materialise



def cropped(plane: Column, width: int, left: int, top: int, w: int, h: int) -> Column:
    """A rectangle of a plane of rows of ``width``."""
    rows = F.sequence(F.lit(top), F.lit(top + h - 1))
    return F.flatten(F.transform(rows, lambda y: F.slice(plane, y * width + left + 1, w)))


def rotated(plane: Column, width: int, height: int, quarter: int) -> Column:
    """A plane turned clockwise by quarters."""
    if quarter % 4 == 0:
        return plane
    place = {
        1: lambda i: (height - 1 - i % height) * width + div(i, height),
        2: lambda i: width * height - 1 - i,
        3: lambda i: (i % height) * width + (width - 1 - div(i, height)),
    }[quarter % 4]
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.get(plane, place(i).cast("int")))


def halved_plane(plane: Column, width: int, height: int) -> Column:
    """Half the size: means of 2x2 blocks, rounded."""
    def at(i: Column) -> Column:
        x, y = (i % (width // 2)) * 2, div(i, width // 2) * 2
        return F.shiftright(sum((F.get(plane, ((y + b) * width + x + a).cast("int")) for a in (0, 1) for b in (0, 1)), F.lit(2)), 2).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit((width // 2) * (height // 2) - 1)), at)


#: How many halves of the free width and height lie before the region.
GRAVITY = {"center": (1, 1), "left": (0, 1), "top": (1, 0), "right": (2, 1), "bottom": (1, 2)}


def gravity_region(width: Column, height: Column, w: Column, h: Column, gravity: str = "heuristic") -> Column:
    """Where a region of w x h lies in an image; one that is larger begins at 0 and is as wide or high as the image.

    ``heuristic`` is the top of an image that is higher than wide, else the middle.
    """
    def place(free: Column, axis: int) -> Column:
        halves = F.when(height > width, GRAVITY["top"][axis]).otherwise(GRAVITY["center"][axis]) if gravity == "heuristic" else F.lit(GRAVITY[gravity][axis])
        return F.when(free < 0, 0).otherwise(div(free * halves, 2))

    return F.struct(F.least(w, width).alias("width"), F.least(h, height).alias("height"), place(width - w, 0).alias("left"), place(height - h, 1).alias("top"))


def turns(orientation: Column) -> Column:
    """Quarter turns of an EXIF orientation."""
    return F.when(orientation == 6, 1).when(orientation == 3, 2).when(orientation == 8, 3).otherwise(0)


def rotation_of_matrix(a: Column, b: Column) -> Column:
    """Quarter turns of the first column of a track matrix."""
    return F.pmod(F.round(F.degrees(F.atan2(b, a)) / 90), F.lit(4)).cast("int")


def matrix_of_rotation(quarter: Column) -> Column:
    cos = F.when(quarter == 0, 1).when(quarter == 2, -1).otherwise(0)
    sin = F.when(quarter == 1, 1).when(quarter == 3, -1).otherwise(0)
    return F.array(cos, sin, F.lit(0), -sin, cos, F.lit(0), F.lit(0), F.lit(0), F.lit(1))


#: Bins of an axis, and how far the search box reaches on each, for palettes of several colours (Lab) and of one (HSV).
SEARCH = {"lab": (24, (4, 1, 1)), "hsv": (16, (1, 2, 4))}
#: Alpha above which a pixel counts, and the share of an image above which a colour does.
SEEN, LEAST_SHARE = 128, 0.001
#: Decimals of sums that are compared.
EXACT = 6


def binned(pixels: DataFrame, space: str = "lab") -> DataFrame:
    """``pixels`` (r, g, b, and a if they have alpha) that can be seen, with the bin (x, y, z) of their colour and its ``weight``: in Lab how far it is from grey, in HSV 1."""
    size = SEARCH[space][0]
    units = [byte_to_unit(F.col(c)) for c in "rgb"]
    seen = pixels.where(F.col("a") > SEEN) if "a" in pixels.columns else pixels
    rows = seen.withColumn("__c", lab(*units) if space == "lab" else hsv(*units))
    c = [F.col(f"__c.{n}") for n in space]
    place = lambda v: F.greatest(F.lit(0), F.least(F.lit(size - 1), (v * size).cast("int")))
    grey = F.sqrt((c[1] - 0.5) * (c[1] - 0.5) + (c[2] - 0.5) * (c[2] - 0.5))
    weight = F.greatest(F.abs(c[0] - 0.5), grey) if space == "lab" else F.lit(1.0)
    return rows.withColumns({"x": place(c[0]), "y": place(c[1]), "z": place(c[2]), "weight": weight}).drop("__c")


def histogram(pixels: DataFrame, keys: list[str], space: str = "lab") -> DataFrame:
    """(keys, x, y, z, weight): the summed weights of each image's bins that have any."""
    return binned(pixels, space).groupBy(*keys, "x", "y", "z").agg(F.round(F.sum("weight"), EXACT).alias("weight"))


def _box_sums(volume: np.ndarray, reach: tuple[int, int, int], wraps: bool) -> np.ndarray:
    """The sum of every box around a cell, from eight values of the running sums; the first axis can go round."""
    size = len(volume)
    padded = np.zeros([size + 2 * r + 1 for r in reach])
    padded[tuple(slice(r + 1, r + 1 + size) for r in reach)] = volume
    if wraps:  # what lies before the first is the last but one, as what is looked up there is moved by one
        r = reach[0]
        inside = padded[r + 1 : r + 1 + size].copy()
        for k in range(1, r + 1):
            padded[r + 1 - k], padded[r + size + k] = inside[size - k - 1], inside[k - 1]
    sums = padded.cumsum(0).cumsum(1).cumsum(2)
    out = np.zeros(volume.shape)
    for corner in range(8):
        up = [corner >> k & 1 for k in range(3)]
        cut = tuple(slice(2 * r + 1, 2 * r + 1 + size) if u else slice(0, size) for r, u in zip(reach, up, strict=True))
        out += (-1) ** (3 - sum(up)) * sums[cut]
    return out.round(EXACT)


_PEAKS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("z", pa.int32()), ("total", pa.float64())]))


def peaks(bins: DataFrame, keys: list[str], count: int, space: str = "lab") -> DataFrame:
    """(keys, n, x, y, z, total): the boxes of bins with the largest sums, ``count`` for each key.

    One after the other: bins of a box that is chosen count negative from then on, so boxes may overlap but what is taken isn't
    taken again. Boxes are centred on any bin; of equal sums the first in the order of bins is chosen, none if no sum is positive.
    An image has at most 13,824 bins, which travel as one value.
    """
    size, reach = SEARCH[space]
    listed = bins.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "z", F.col("weight").cast("double").alias("w"))).alias("__bins"))

    @F.arrow_udf("array<struct<x:int,y:int,z:int,total:double>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for held in batch.to_pylist():
                volume = np.zeros((size, size, size))
                for b in held:
                    volume[b["x"], b["y"], b["z"]] = b["w"]
                chosen = []
                for _ in range(count):
                    sums = _box_sums(volume, reach, space == "hsv")
                    at = np.unravel_index(int(sums.argmax()), sums.shape)
                    if sums[at] <= 0:
                        break
                    chosen.append(dict(zip(("x", "y", "z", "total"), (*map(int, at), float(sums[at])), strict=True)))
                    near = tuple(slice(max(0, c - r), c + r + 1) for c, r in zip(at, reach, strict=True))
                    volume[near] = -np.abs(volume[near])
                out.append(chosen)
            yield pa.array(out, _PEAKS)

    return listed.select(*keys, F.posexplode(found("__bins")).alias("n", "b")).select(*keys, "n", "b.x", "b.y", "b.z", "b.total")


def _palettes(colours: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """(keys, palette): the numbered colours of each image in one value."""
    return colours.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", *axes))).alias("palette"))


def _nearest(pixels: DataFrame, palettes: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    joined = pixels.join(palettes, keys)

    def far(p: Column) -> Column:
        return sum(((p[a] - F.col(a)) * (p[a] - F.col(a)) for a in axes[1:]), (p[axes[0]] - F.col(axes[0])) * (p[axes[0]] - F.col(axes[0])))

    return joined.withColumn("n", F.array_min(F.transform("palette", lambda p: F.struct(far(p).alias("d"), p["n"].alias("n"))))["n"]).drop("palette")


def nearest(pixels: DataFrame, palette: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Each pixel's nearest colour of its image's palette (at most a few colours a key)."""
    return _nearest(pixels, _palettes(palette, keys, axes), keys, axes)


def means(pixels: DataFrame, keys: list[str], axes: list[str], k: int, rounds: int = 100, delta: float = 1e-8) -> DataFrame:
    """(keys, n, axes): k-means of each image's pixels, from ``k`` of its different colours evenly spaced in their order.

    Pixels are counted by colour once, as all of one colour go to the same centre; that table is what every round reads.
    Each round gives every colour its nearest centre, of which an image has ``k`` in one value, and averages
    colours by centre, weighted by their pixels and summed before they are shuffled; it is written as a table of one row an image. It
    ends when no centre moves by more than ``delta``, after ``rounds`` at the latest. A centre without pixels stays.
    """
    points = materialise(pixels.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("__pixels")), "colours")
    order = Window.partitionBy(*keys).orderBy(*axes)
    ranked = points.withColumns({"at": F.row_number().over(order) - 1, "of": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    m = F.least(F.col("of"), F.lit(k))
    places = F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda i: F.when(m > 1, div(i * (F.col("of") - 1), F.greatest(m - 1, F.lit(1)))).otherwise(0))
    number = F.array_position(places, F.col("at").cast("long")) - 1
    first = ranked.withColumn("n", number.cast("int")).where("n >= 0").select(*keys, "n", *[F.col(a).cast("double").alias(a) for a in axes])
    centres = materialise(_palettes(first, keys, axes), "centres")
    for _ in range(rounds):
        sums = _nearest(points, centres, keys, axes).groupBy(*keys, "n").agg(F.sum("__pixels").alias("__all"), *[F.sum(F.col(a) * F.col("__pixels")).alias(a) for a in axes])
        moved = _palettes(sums.select(*keys, "n", *[(F.col(a) / F.col("__all")).alias(a) for a in axes]), keys, axes).withColumnRenamed("palette", "__moved")
        new = lambda p: F.coalesce(F.get(F.filter("__moved", lambda q: q["n"] == p["n"]), 0), p)
        stepped = centres.join(moved, keys, "left").withColumn("__moved", F.transform("palette", new))
        far = F.zip_with("palette", "__moved", lambda p, q: F.greatest(F.lit(0.0), *[F.abs(q[a] - p[a]) for a in axes]))
        after = materialise(stepped.select(*keys, F.col("__moved").alias("palette"), F.array_max(far).alias("far")), "centres")
        discard(centres)
        centres = after.drop("far")
        if after.where(F.col("far") > delta).isEmpty():
            break
    discard(points)
    return centres.select(*keys, F.explode("palette").alias("p")).select(*keys, "p.n", *[f"p.{a}" for a in axes])


# ---------------------------------------------------------------- resampling

def sinc(x: Column) -> Column:
    px = x * math.pi
    return F.when(F.abs(x) < 1e-9, F.lit(1.0)).otherwise(F.sin(px) / px)


def lanczos(x: Column, lobes: int = 3) -> Column:
    return F.when(F.abs(x) >= lobes, F.lit(0.0)).otherwise(sinc(x) * sinc(x / float(lobes)))


def mitchell(x: Column) -> Column:
    """Mitchell-Netravali with both parameters a third."""
    a = F.abs(x)
    near = (a * a * a * 7.0 - a * a * 12.0 + 16.0 / 3.0) / 6.0
    far = (a * a * a * (-7.0 / 3.0) + a * a * 12.0 - a * 20.0 + 32.0 / 3.0) / 6.0
    return F.when(a < 1, near).when(a < 2, far).otherwise(F.lit(0.0))


def triangle(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(x))


def bessel0(x: Column) -> Column:
    """Modified Bessel function of order zero, by its series."""
    term, out = F.lit(1.0), F.lit(1.0)
    for k in range(1, 16):
        term = term * (x * x) / F.lit(4.0 * k * k)
        out = out + term
    return out


def kaiser(x: Column, alpha: float = 4.0, half: float = 3.0) -> Column:
    inside = F.greatest(F.lit(0.0), F.lit(1.0) - (x / half) * (x / half))
    return F.when(F.abs(x) > half, F.lit(0.0)).otherwise(bessel0(F.sqrt(inside) * alpha) / bessel0(F.lit(alpha)))


def weights(spark: SparkSession, source: int, target: int, kernel=lanczos, lobes: int = 3) -> DataFrame:
    """(out_idx, tap, weight, fixed): normalised taps that resample ``source`` samples to ``target``; ``fixed`` is 16.16."""
    scale = max(1.0, source / target)
    reach = math.ceil(lobes * scale)
    centre = (F.col("out_idx") + 0.5) * (source / target)
    taps = spark.range(target).select(F.col("id").alias("out_idx")).withColumn("tap", F.explode(F.sequence(F.floor(centre - reach).cast("long"), F.ceil(centre + reach).cast("long"))))
    raw = taps.where(f"tap >= 0 and tap < {source}").withColumn("raw", kernel((F.col("tap") + 0.5 - centre) / scale)).where("raw <> 0")
    whole = F.sum("raw").over(Window.partitionBy("out_idx"))
    return raw.select("out_idx", "tap", (F.col("raw") / whole).alias("weight"), F.round(F.col("raw") / whole * 65536).cast("int").alias("fixed"))


def resampled(planes: DataFrame, keys: list[str], taps: DataFrame, axis: str, plane_axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Values (keys, x, y, v) along one axis by 16.16 weights (out_idx, tap, fixed): an equi-join of values and taps, then a sum for each place.

    The taps of an axis are a few times its length, so the join is a broadcast by their size; the sums are
    pre-aggregated. Results are rounded and kept within a byte.
    """
    other = plane_axes[1] if axis == plane_axes[0] else plane_axes[0]
    joined = planes.join(taps.select(F.col("tap").cast("int").alias(axis), F.col("out_idx").cast("int").alias("out"), "fixed"), axis)
    sums = joined.groupBy(*keys, other, "out").agg(F.sum(F.col("v") * F.col("fixed").cast("long")).alias("s"))
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(F.col("s") + 32768, 16))).cast("int")
    return sums.select(*keys, other, F.col("out").alias(axis), value.alias("v"))


def pixels_of(planes: DataFrame, keys: list[str], plane: str, width: int) -> DataFrame:
    """Planes of rows of ``width`` as (keys, x, y, v)."""
    rows = planes.select(*keys, F.posexplode(plane).alias("i", "v"))
    return rows.select(*keys, (F.col("i") % width).alias("x"), div(F.col("i"), width).cast("int").alias("y"), "v")


def looked_up(pixels: DataFrame, table: DataFrame, value: str = "v") -> DataFrame:
    """Values through a table (value, out) of at most 256 rows: an equi-join on the byte."""
    return pixels.join(table, value)


def palette(pixels: DataFrame, keys: list[str], count: int, order: list[str]) -> DataFrame:
    """(keys, place, r, g, b, share): the colours of each image, largest share of all its pixels first.

    Each peak stands for the pixels in its box, whose upper median of each channel is looked up among their own colours: the nearest
    one, of equally near ones the first in the ``order`` of pixels. One colour is searched in HSV, several in Lab. Colours are
    counted before they are shuffled, and medians are read off counts of at most 256 values.
    """
    space = "hsv" if count == 1 else "lab"
    size, reach = SEARCH[space]
    shown = binned(pixels, space)
    found = peaks(shown.groupBy(*keys, "x", "y", "z").agg(F.round(F.sum("weight"), EXACT).alias("weight")), keys, count, space)
    listed = found.groupBy(*keys).agg(F.collect_list(F.struct("n", "x", "y", "z")).alias("__peaks"))
    all_pixels = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    away = lambda p, c: F.abs(F.col(c) - p[c]) % size if space == "hsv" and c == "x" else F.abs(F.col(c) - p[c])
    inside = lambda p: (away(p, "x") <= reach[0]) & (away(p, "y") <= reach[1]) & (away(p, "z") <= reach[2])
    colours = shown.groupBy(*keys, "x", "y", "z", "r", "g", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*order)).alias("__first"))
    each = colours.join(listed, keys).withColumn("p", F.explode(F.filter("__peaks", inside))).select(*keys, F.col("p.n").alias("n"), "r", "g", "b", "c", "__first")

    channel = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in "rgb"]))
    counts = each.select(*keys, "n", "c", channel.alias("h")).groupBy(*keys, "n", "h.axis", "h.v").agg(F.sum("c").alias("c"))
    one = Window.partitionBy(*keys, "n", "axis")
    counts = counts.withColumns({"so_far": F.sum("c").over(one.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "size": F.sum("c").over(one)})
    middle = counts.where(F.col("so_far") > div(F.col("size"), 2)).groupBy(*keys, "n").agg(*[F.min(F.when(F.col("axis") == a, F.col("v"))).alias(f"m_{a}") for a in "rgb"], F.max("size").alias("size"))
    near = each.join(middle, [*keys, "n"])
    far = sum(((F.col(a) - F.col(f"m_{a}")) * (F.col(a) - F.col(f"m_{a}")) for a in "gb"), (F.col("r") - F.col("m_r")) * (F.col("r") - F.col("m_r")))
    best = near.groupBy(*keys, "n").agg(F.min(F.struct(far.alias("far"), "__first", "r", "g", "b")).alias("x"), F.max("size").alias("size"))
    shares = best.join(all_pixels, keys).withColumn("share", F.col("size") / F.col("__all")).where(F.col("share") > LEAST_SHARE)
    ranked = Window.partitionBy(*keys).orderBy(F.desc("share"), "n")
    return shares.select(*keys, (F.row_number().over(ranked) - 1).alias("place"), "x.r", "x.g", "x.b", "share")


# ---------------------------------------------------------------- frames of one image

#: What becomes of a frame before the next one is drawn.
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3


def composited(frames: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, idx, x, y, v, alpha): each frame of an image as it is shown.

    ``frames`` have ``idx`` from 0, a region (``left``, ``top``, ``width``, ``height``), a ``disposal`` and the array ``values`` of the
    region's pixels by rows, null where they are transparent. What a frame doesn't cover stays as it was; a region that is cleared, and
    what the first frame leaves transparent in its region, is white without alpha; before all frames there is nothing.

    A frame that gives way to what was before it shows in its own place only, so a pixel shows its own value, or the newest one
    of the frames before that stay: a running last value by pixel. A clearing that is followed by such a frame shows with it and is
    taken back with it. Frames of that kind that no other frame precedes stay, as nothing was kept to go back to.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    before = F.lag("disposal").over(order)
    others = F.max((F.col("disposal") != PREVIOUS).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    last_region = F.struct("left", "top", "width", "height")
    rows = frames.withColumns({"__stays": (F.col("disposal") != PREVIOUS) | (F.coalesce(others, F.lit(0)) == 0), "__cleared": F.when(before == BACKGROUND, F.lag(last_region).over(order))})
    places = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))
    rows = rows.withColumn("__at", places).withColumns({"x": (F.col("__at") % width).cast("int"), "y": div(F.col("__at"), width).cast("int")})
    covers = lambda r: (F.col("x") >= r("left")) & (F.col("x") < r("left") + r("width")) & (F.col("y") >= r("top")) & (F.col("y") < r("top") + r("height"))
    inside = covers(F.col)
    value = F.when(inside, F.get("values", ((F.col("y") - F.col("top")) * F.col("width") + F.col("x") - F.col("left")).cast("int")))
    colour = lambda v, alpha: F.struct(v.cast("int").alias("v"), F.lit(alpha).alias("alpha"))
    white = colour(F.lit(255), 0)
    drawn = F.when(value.isNotNull(), colour(value, 255)).when(inside & (F.col("idx") == 0), white)
    cleared = F.when(F.coalesce(covers(lambda c: F.col(f"__cleared.{c}")), F.lit(False)), white)
    rows = rows.select(*keys, "idx", "x", "y", "__stays", F.coalesce(drawn, cleared).alias("__new"))
    kept = F.last(F.when(F.col("__stays"), F.col("__new")), ignorenulls=True)
    pixel = Window.partitionBy(*keys, "x", "y").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.coalesce("__new", kept.over(pixel), colour(F.lit(0), 0))
    return rows.withColumn("__shown", shown).select(*keys, "idx", "x", "y", F.col("__shown.v").alias("v"), F.col("__shown.alpha").alias("alpha"))
