"""Geometry, colour and schedule arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def align_up(n: Column, to: int) -> Column:
    return F.ceil(n / to) * to


def align_down(n: Column, to: int) -> Column:
    return F.floor(n / to) * to


def cover(w: Column, h: Column, tw: int, th: int) -> tuple[Column, Column]:
    """Size that covers tw x th at the source's aspect, rounded up."""
    scale = F.greatest(tw / w, th / h)
    return F.ceil(w * scale), F.ceil(h * scale)


def fit(w: Column, h: Column, tw: int, th: int) -> tuple[Column, Column]:
    """Size inside tw x th, half to even."""
    scale = F.least(tw / w, th / h)
    return F.rint(w * scale).cast("long"), F.rint(h * scale).cast("long")


def long_side(w: Column, h: Column, to: int) -> tuple[Column, Column]:
    scale = to / F.greatest(w, h)
    return F.rint(w * scale).cast("long"), F.rint(h * scale).cast("long")


def centre_crop(w: Column, h: Column, aspect: float) -> tuple[Column, Column, Column, Column]:
    """(x, y, width, height) of the largest centred crop of an aspect."""
    wide = w / h > aspect
    cw = F.when(wide, F.rint(h * aspect)).otherwise(w).cast("long")
    ch = F.when(wide, h).otherwise(F.rint(w / aspect)).cast("long")
    return F.floor((w - cw) / 2), F.floor((h - ch) / 2), cw, ch


def clamp(x: Column, lo, hi) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lift(lo), F.least(lift(hi), x))


def map_range(x: Column, a: float, b: float, c: float, d: float) -> Column:
    return c + (clamp(x, a, b) - a) * (d - c) / (b - a)


def srgb(x: Column) -> Column:
    """Linear light to sRGB."""
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.709 luma of full-range RGB."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def lerp_masked(x: Column, clean: Column, mask: Column) -> Column:
    return x * mask + clean * (1 - mask)


def guided(cond: Column, uncond: Column, scale: float) -> Column:
    return cond + (scale - 1) * (cond - uncond)


def velocity(sample: Column, sigma: Column, denoised: Column) -> Column:
    return (sample - denoised) / sigma


def denoised(sample: Column, sigma: Column, velocity_: Column) -> Column:
    return sample - velocity_ * sigma


def linear_shift(tokens: Column, lo: tuple[float, float], hi: tuple[float, float]) -> Column:
    """A shift that runs linearly between two (tokens, shift) points."""
    slope = (hi[1] - lo[1]) / (hi[0] - lo[0])
    return lo[1] + slope * (tokens - lo[0])


#: The constants of a camera log curve (slope, offset, gain, shift of the
#: logarithmic part; slope and offset of the linear part; where they meet).
LOG_A, LOG_B, LOG_C, LOG_D, LOG_E, LOG_F, LOG_CUT = 5.555556, 0.052272, 0.247190, 0.385537, 5.367655, 0.092809, 0.010591


def log_encode(x: Column) -> Column:
    """Scene light to log: logarithmic above the cut, linear below."""
    return F.when(x > LOG_CUT, LOG_C * F.log10(LOG_A * x + LOG_B) + LOG_D).otherwise(LOG_E * x + LOG_F)


def log_decode(y: Column) -> Column:
    bright = (F.pow(F.lit(10.0), (y - LOG_D) / LOG_C) - LOG_B) / LOG_A
    return F.when(y > LOG_E * LOG_CUT + LOG_F, bright).otherwise((y - LOG_F) / LOG_E)


def yuv(r: Column, g: Column, b: Column, kr: float = 0.2126, kb: float = 0.0722, full: bool = False) -> tuple[Column, Column, Column]:
    """8-bit luma and chroma of RGB in 0..1; limited range unless ``full``."""
    y = kr * r + (1 - kr - kb) * g + kb * b
    u, v = (b - y) / (2 * (1 - kb)), (r - y) / (2 * (1 - kr))
    if full:
        return y * 255, u * 255 + 128, v * 255 + 128
    return y * 219 + 16, u * 224 + 128, v * 224 + 128


#: Gain of centre and surround channels in a stereo mix.
MINUS_3_DB = 0.7071067811865476


def downmix(channels: Column) -> tuple[Column, Column]:
    """Stereo from 5.1 (L R C LFE Ls Rs) or 7.1 (.. Lb Rb Ls Rs); mono doubles, stereo stays,
    other layouts become their mean on both sides."""
    c = lambda i: F.get(channels, i)
    n = F.size(channels)
    mean = F.aggregate(channels, F.lit(0.0), lambda acc, x: acc + x) / n

    def side(front: int, surrounds5: int, back7: int, side7: int) -> Column:
        five = c(front) + MINUS_3_DB * (c(2) + c(surrounds5))
        seven = c(front) + MINUS_3_DB * (c(2) + c(back7) + c(side7))
        return F.when(n == 1, c(0)).when(n == 2, c(front)).when(n == 6, five).when(n == 8, seven).otherwise(mean)

    return side(0, 4, 4, 6), side(1, 5, 5, 7)


def phi(j: int, z: Column) -> Column:
    """phi_j of exponential integrators: phi_0 = e^z, phi_j = (phi_{j-1} - 1/(j-1)!) / z; its series at 0."""
    import math

    if j == 0:
        return F.exp(z)
    series = sum((F.pow(z, F.lit(k)) / math.factorial(k + j) for k in range(1, 10)), F.lit(1.0 / math.factorial(j)))
    return F.when(F.abs(z) < 1e-2, series).otherwise((phi(j - 1, z) - 1.0 / math.factorial(j - 1)) / z)


def ancestral(sigma: Column, sigma_next: Column, eta: float) -> tuple[Column, Column]:
    """(step down to, noise to add) of an ancestral step."""
    up = F.least(sigma_next, eta * F.sqrt(sigma_next * sigma_next * (sigma * sigma - sigma_next * sigma_next) / (sigma * sigma)))
    return F.sqrt(sigma_next * sigma_next - up * up), up


def log_aspect_distance(w: Column, h: Column, bw: Column, bh: Column) -> Column:
    return F.abs(F.log(w / h) - F.log(bw / bh))


def crop_risks(w: Column, h: Column, tw: int, th: int) -> dict[str, Column]:
    """A centred crop that covers tw x th: scaled size, offsets, share of the picture kept, and what may go wrong."""
    scale = F.greatest(tw / w, th / h)
    sw, sh = (F.greatest(F.lit(to), F.rint(c * scale).cast("long")) for to, c in ((tw, w), (th, h)))
    kept = float(tw * th) / (sw * sh)
    wide = tw / th
    return {
        "sw": sw,
        "sh": sh,
        "top": F.floor((sh - th) / 2),
        "left": F.floor((sw - tw) / 2),
        "retained": F.round(kept, 6),
        "severe": kept < 0.7,
        "vertical": sh > th,
        "horizontal": sw > tw,
        "square_to_wide": (F.abs(w / h - 1.0) <= 0.05) & F.lit(wide > 1.5),
        "portrait_to_wide": (w < h) & F.lit(wide > 1),
    }
