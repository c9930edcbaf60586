"""Colour conversions as Column expressions over components in 0..1 or bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.arith import clamp, div

GAMMA = 2.2
#: The Lab range that counts as 0 to 1, D65 white, linear RGB to XYZ and back, and where the curve becomes a line.
LAB_MIN, LAB_MAX = (0.0, -86.1777648, 94.4802017), (100.0, 98.2391204, -107.852676)
WHITE = (95.0429, 100.0, 108.8900)
RGB_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950220))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
LINE_BELOW, LINE = 216.0 / 24389.0, 24389.0 / 27.0
#: Fixed value: the exponent that stands for a cube root.
CUBE_ROOT = 0.333333


def byte_to_unit(b: Column) -> Column:
    return b / F.lit(255.0)


def unit_to_byte(x: Column) -> Column:
    """Truncated, within 0 to 255."""
    return clamp((x * 255.0).cast("int"), F.lit(0), F.lit(255))


def to_linear(x: Column) -> Column:
    return F.pow(x, F.lit(GAMMA))


def to_srgb(x: Column) -> Column:
    return F.pow(x, F.lit(1.0 / GAMMA))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """(h, s, v) in 0..1 of components in 0..1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    sector = F.when(d == 0, F.lit(0.0)).when(high == r, (g - b) / d).when(high == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0) / 6.0
    return F.struct(F.when(sector < 0, sector + 1.0).otherwise(sector).alias("h"), F.when(high == 0, F.lit(0.0)).otherwise(d / high).alias("s"), high.alias("v"))


def _dot(row: tuple[float, ...], values: list[Column]) -> Column:
    return values[0] * row[0] + values[1] * row[1] + values[2] * row[2]


def lab(r: Column, g: Column, b: Column) -> Column:
    """(l, a, b) of sRGB components in 0..1, each as its share of the way from ``LAB_MIN`` to ``LAB_MAX``."""
    linear = [to_linear(c) * 100.0 for c in (r, g, b)]

    def curve(t: Column) -> Column:
        return F.when(t > LINE_BELOW, F.pow(t, F.lit(CUBE_ROOT))).otherwise((t * LINE + 16.0) / 116.0)

    x, y, z = (curve(_dot(row, linear) / w) for row, w in zip(RGB_TO_XYZ, WHITE, strict=True))
    share = [((v - low) / (high - low)).alias(n) for v, low, high, n in zip((y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0), LAB_MIN, LAB_MAX, "lab", strict=True)]
    return F.struct(*share)


def srgb_of_lab(c: Column) -> Column:
    """(r, g, b) of a colour as ``lab`` gives it; what lies below 0 in linear light is 0."""
    l, a, b = (c[n] * (high - low) + low for n, low, high in zip("lab", LAB_MIN, LAB_MAX, strict=True))
    fy = (l + 16.0) / 116.0
    fx, fz = fy + a / 500.0, fy - b / 200.0
    cubed = lambda f: F.when(f * f * f > LINE_BELOW, f * f * f).otherwise((f * 116.0 - 16.0) / LINE)
    y = F.when(l > LINE_BELOW, fy * fy * fy).otherwise(l / LINE)
    xyz = [v * w / 100.0 for v, w in zip((cubed(fx), y, cubed(fz)), WHITE, strict=True)]
    return F.struct(*[to_srgb(F.greatest(_dot(row, xyz), F.lit(0.0))).alias(n) for row, n in zip(XYZ_TO_RGB, "rgb", strict=True)])


#: Integer weights of red, green, blue for y, u and v, before a shift by 8.
YUV_WEIGHTS = {"y": (76, 150, 29, 0), "u": (-43, -84, 127, 128), "v": (127, -106, -21, 128)}


def yuv(r: Column, g: Column, b: Column) -> Column:
    """Full-range (y, u, v) bytes of red, green and blue bytes, in integers."""
    parts = [(F.shiftright(r * kr + g * kg + b * kb, 8) + add).cast("int").alias(name) for name, (kr, kg, kb, add) in YUV_WEIGHTS.items()]
    return F.struct(*parts)


def limited_range(v: Column, chroma: bool = False) -> Column:
    """A full-range byte in 16..235, or 16..240 for chroma."""
    return (div(v * (224 if chroma else 219), 255) + 16).cast("int")


def full_range(v: Column, chroma: bool = False) -> Column:
    """A limited-range byte in 0..255."""
    return clamp(div((v - 16) * 255, 224 if chroma else 219), F.lit(0), F.lit(255)).cast("int")


def over(top: Column, bottom: Column, alpha: Column) -> Column:
    """Alpha blend of sRGB components in linear space."""
    return to_srgb(to_linear(top) * alpha + to_linear(bottom) * (F.lit(1.0) - alpha))


def all_opaque(alphas: Column) -> Column:
    return ~F.exists(alphas, lambda a: a != 255)


def chroma_average(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The mean of a 2x2 block, truncated."""
    return F.shiftright(a + b + c + d, 2)
