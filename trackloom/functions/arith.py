"""Integer and track arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once: inside a lambda an expression is evaluated anew at each of its uses, a variable isn't."""
    return F.get(F.transform(F.array(value), use), 0)


def div(a, b) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", _c(a), _c(b))


def round_divide(x, num, den) -> Column:
    """x * num / den rounded half up (half is den div 2)."""
    return div(_c(x) * _c(num) + div(den, 2), den)


def ceil_divide(x, num, den) -> Column:
    return div(_c(x) * _c(num) + _c(den) - 1, den)


def align_shift(x, shift: int) -> Column:
    """x rounded up to a multiple of 2**shift."""
    return F.shiftleft(F.shiftright(_c(x) + ((1 << shift) - 1), shift), shift)


def align_divide(x, shift: int) -> Column:
    return F.shiftright(_c(x) + ((1 << shift) - 1), shift)


def align(x, step) -> Column:
    return div(_c(x) + _c(step) - 1, step) * _c(step)


def is_even(x) -> Column:
    return _c(x).bitwiseAND(F.lit(1)) == 0


def even(x) -> Column:
    """x rounded up to an even number."""
    return _c(x) + _c(x).bitwiseAND(F.lit(1))


def even_floor(x) -> Column:
    return _c(x) - _c(x).bitwiseAND(F.lit(1))


def lerp(a, b, t) -> Column:
    return _c(a) + (_c(b) - _c(a)) * _c(t)


def step(edge, x) -> Column:
    return F.when(_c(x) >= _c(edge), F.lit(1.0)).otherwise(F.lit(0.0))


def clamp(x, low, high) -> Column:
    return F.greatest(_c(low), F.least(_c(high), _c(x)))


def saturate(x) -> Column:
    return clamp(x, F.lit(0.0), F.lit(1.0))


def luminance(r, g, b) -> Column:
    """Relative luminance of linear components."""
    return F.lit(0.2126) * _c(r) + F.lit(0.7152) * _c(g) + F.lit(0.0722) * _c(b)


def half_rounded(x) -> Column:
    return F.shiftright(_c(x) + 1, 1)


def whole_median(x) -> Column:
    """Median of integers; the mean of a middle pair is truncated, no rows give 0."""
    return F.coalesce(F.floor(F.median(x)).cast("long"), F.lit(0).cast("long"))


def whole_mean(x) -> Column:
    """Mean of integers, truncated; no rows give 0."""
    return F.coalesce(div(F.sum(x), F.nullif(F.count(x), F.lit(0).cast("long"))), F.lit(0).cast("long"))


def variance(x) -> Column:
    return F.var_pop(x)


def std_dev(x) -> Column:
    return F.stddev_pop(x)


def psnr(mse) -> Column:
    """Peak signal-to-noise ratio of 8-bit samples; null where nothing differs."""
    return F.when(_c(mse) > 0, F.lit(10.0) * F.log10(F.lit(65025.0) / _c(mse)))


def rational_whole(num, den) -> Column:
    return div(num, den)


def rational_rest(num, den) -> Column:
    return _c(num) % _c(den)


def rational_value(num, den) -> Column:
    return _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))


# ---------------------------------------------------------------- time

def ms_to_ticks(ms, timescale) -> Column:
    """Start of a range: floor."""
    return div(_c(ms) * _c(timescale), 1000)


def ms_to_ticks_up(ms, timescale) -> Column:
    """Length of a range: ceiling."""
    return div(_c(ms) * _c(timescale) + 999, 1000)


def single(x) -> Column:
    """A number in single precision. The product keeps it there: of two casts in a row Catalyst leaves out the one to float."""
    return _c(x).cast("float") * F.lit(1.0).cast("float")


def seconds(ticks, timescale) -> Column:
    """Seconds in single precision, as ordering by time needs them."""
    return (single(ticks) / single(timescale)).cast("float")


def to_90khz(ticks, timescale) -> Column:
    return div(_c(ticks) * 90000, timescale)


def ns_to_ticks(ns, timescale) -> Column:
    return round_divide(ns, timescale, F.lit(1_000_000_000).cast("long"))


def shifted_dts(dts, pts, offset_seconds, timescale) -> Column:
    """dts moved by an offset in seconds; a negative offset means there is none, and pts is used."""
    return F.when(_c(offset_seconds) < 0, _c(pts)).otherwise(_c(dts) + F.round(_c(offset_seconds) * _c(timescale)).cast("long"))


def repaired_offset(offset) -> Column:
    """A composition offset stored unsigned that was meant signed."""
    top = (1 << 32) - 1 - 32768
    return F.when(_c(offset) > top, _c(offset) - (1 << 32)).otherwise(_c(offset))


# ---------------------------------------------------------------- encoder settings

def h264_profile(width, height) -> Column:
    size = F.least(_c(width), _c(height))
    return F.when(size <= 480, "baseline").when(size <= 720, "main").otherwise("high")


#: Sample rates at which Vorbis bands begin, with the greatest bitrates of one and two channels.
VORBIS_BANDS = ((8000, 42000, 32000), (9000, 50000, 44000), (15000, 100000, 86000), (19000, 90000, 86000), (26000, 190000, 190000), (40000, 240000, 250000))
#: Sample rates that sound may have.
SAMPLE_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
#: Codecs by kind.
AAC, PCM = ("aac_main", "aac_lc", "aac_lc_sbr"), ("pcm_s16le", "pcm_s16be", "pcm_s24le", "pcm_s24be")
IMAGES = ("jpg", "png", "gif", "bmp", "webp", "tiff")
MAX_DIMENSION, MAX_IMAGE_SIDE, MAX_IMAGE_PIXELS = 0x2000, 16384, 8192 * 8192


def vorbis_bitrate(sample_rate, channels, bitrate) -> Column:
    """A bitrate kept within what the band of a sample rate allows; from the last band's rate on it is not limited, below the first there is none (null)."""
    out = F.when(_c(sample_rate) < VORBIS_BANDS[0][0], F.lit(None).cast("int"))
    for (_, one, two), (upper, *_) in zip(VORBIS_BANDS, VORBIS_BANDS[1:], strict=False):
        out = out.when(_c(sample_rate) < upper, F.least(_c(bitrate), F.when(_c(channels) == 1, one).otherwise(two)))
    return out.otherwise(_c(bitrate))


def is_aac(codec) -> Column:
    return F.coalesce(_c(codec).isin(*AAC), F.lit(False))


def is_pcm(codec) -> Column:
    return F.coalesce(_c(codec).isin(*PCM), F.lit(False))


def is_image(codec) -> Column:
    return F.coalesce(_c(codec).isin(*IMAGES), F.lit(False))


def known_sample_rate(rate) -> Column:
    return _c(rate).isin(*SAMPLE_RATES)


def valid_dimensions(width, height) -> Column:
    """Sizes a video may have."""
    return _c(width).between(1, MAX_DIMENSION) & _c(height).between(1, MAX_DIMENSION)


def valid_image_size(width, height) -> Column:
    return _c(width).between(1, MAX_IMAGE_SIDE) & _c(height).between(1, MAX_IMAGE_SIDE) & (_c(width).cast("long") * _c(height).cast("long") <= MAX_IMAGE_PIXELS)


def encoder_rate(fps, codec: str = "h264") -> Column:
    """Frames in a thousand seconds, rounded; VP8 takes no less than one a second."""
    rate = F.greatest(_c(fps), F.lit(1.0)) if codec == "vp8" else _c(fps)
    return F.floor(rate * 1000.0 + 0.5).cast("int")


def display_size(coded_width, coded_height, par_width, par_height) -> tuple[Column, Column]:
    """Display size of a coded size and pixel aspect; the stretched side is floored to an even number."""
    wide = _c(par_width) > _c(par_height)
    tall = _c(par_height) > _c(par_width)
    w = F.when(wide, even_floor(div(_c(coded_width) * _c(par_width), par_height))).otherwise(_c(coded_width))
    h = F.when(tall, even_floor(div(_c(coded_height) * _c(par_height), par_width))).otherwise(_c(coded_height))
    return w, h


def output_size(width, height, wanted, orientation=0, square: bool = False) -> tuple[Column, Column]:
    """A size whose smaller side becomes ``wanted`` (0 leaves it), made square by its smaller side if asked, and turned if the orientation is odd."""
    least = F.least(_c(width), _c(height))
    scaled = lambda x: F.when(_c(wanted) == 0, _c(x)).otherwise(round_divide(x, wanted, least))
    w, h = scaled(width), scaled(height)
    if square:
        w = h = F.least(w, h)
    turned = F.pmod(_c(orientation), F.lit(2)) == 1
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def padding(size, buckets: list[int]) -> Column:
    """Bytes that pad ``size`` to the next bucket; beyond the last of several, buckets go on by the last difference. An exact bucket needs none, nor does anything beyond a lone one."""
    size = _c(size)
    if not buckets:
        return size.cast("long") * 0
    out = F.when(size < buckets[0], F.lit(buckets[0]) - size)
    for low, high in zip(buckets, buckets[1:], strict=False):
        out = out.when((size > low) & (size < high), F.lit(high) - size)
    if len(buckets) > 1:
        delta = buckets[-1] - buckets[-2]
        out = out.when(size > buckets[-1], F.pmod(F.lit(buckets[-1]) - size, F.lit(delta)))
    return out.otherwise(0).cast("long")
