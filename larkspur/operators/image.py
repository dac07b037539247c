"""Images as rows: pixels row by row with interleaved channels, ``array<double>``, and their size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resize(pixels: Column, size: tuple, to: tuple, channels: int, method: str = "bilinear") -> Column:
    """Nearest or bilinear with pixel centres at halves; array functions only."""
    (h, w), (oh, ow) = size, to
    n = oh * ow * channels

    def one(i: Column) -> Column:
        c, x, y = i % channels, F.floor(i / channels).cast("int") % ow, F.floor(i / (channels * ow)).cast("int")
        at = lambda yy, xx: F.get(pixels, (yy * w + xx) * channels + c)
        clip = lambda v, top: F.greatest(F.lit(0), F.least(v.cast("int"), F.lit(top - 1)))
        if method == "nearest":
            return at(clip(F.floor((y + 0.5) * (h / oh)), h), clip(F.floor((x + 0.5) * (w / ow)), w))
        sy, sx = (y + 0.5) * (h / oh) - 0.5, (x + 0.5) * (w / ow) - 0.5
        y0, x0 = F.floor(sy), F.floor(sx)
        fy, fx = sy - y0, sx - x0
        a, b = clip(y0, h), clip(y0 + 1, h)
        p, q = clip(x0, w), clip(x0 + 1, w)
        return (at(a, p) * (1 - fx) + at(a, q) * fx) * (1 - fy) + (at(b, p) * (1 - fx) + at(b, q) * fx) * fy

    if method not in ("nearest", "bilinear"):
        raise ValueError(f"no method {method!r}")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)
