"""Frames as array columns: size checks, crops, area resampling, luma, validity, composed clips, and colour transforms.

A plane is an array of ``height * width`` numbers, row by row; a frame is a struct of
the planes ``r``, ``g`` and ``b``. Sizes are constants, so weights are literals and all
stays inside the generated code of the stage.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import arrays as A
from sparkloom.functions.text import stable_fraction

PLANES = ("r", "g", "b")
#: Share of the height that holds the picture; below are captions. Fixed values.
ACTIVE = 0.85
BLACK_MEAN, BLACK_P99 = 3.0, 10.0


def demanded(plane: Column, size: int) -> Column:
    """The plane, if it has ``size`` values; otherwise an error that says how many. A null plane is an error."""
    told = F.concat(F.lit(f"expected {size} values, got "), F.coalesce(F.size(plane).cast("string"), F.lit("none")))
    return F.when(F.size(plane) == size, plane).otherwise(F.raise_error(told).cast("array<double>"))


def top(plane: Column, height: int, width: int, share: float = ACTIVE) -> Column:
    """The upper rows: ``share`` of them, cut to a whole number."""
    return F.slice(plane, 1, int(height * share) * width)


def blanked(plane: Column, height: int, width: int, share: float = ACTIVE) -> Column:
    """The plane with 0 below its upper rows."""
    rows = int(height * share)
    return F.concat(F.slice(plane, 1, rows * width).cast("array<double>"), F.array_repeat(F.lit(0.0), (height - rows) * width))


def area_weights(n: int, m: int) -> list[list[tuple[int, float]]]:
    """For each of ``m`` cells laid over ``n`` others: the cells that it covers and their shares of it."""
    if n < 1 or m < 1:
        raise ValueError("a plane has rows and columns")
    out = []
    for k in range(m):
        a, b = Fraction(k * n, m), Fraction((k + 1) * n, m)
        cells = range(int(a), -(-b.numerator // b.denominator))
        out.append([(i, float((min(b, i + 1) - max(a, i)) * m / n)) for i in cells])
    return out


def _weights(n: int, m: int) -> Column:
    return F.array(*(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in cell)) for cell in area_weights(n, m)))


def resampled(plane: Column, size: tuple[int, int], to: tuple[int, int]) -> Column:
    """The plane at another size; each new value is the mean of the area that it covers."""
    (height, width), (rows, columns) = size, to
    mean = lambda cells, value: F.aggregate(cells, F.lit(0.0), lambda a, c: a + c.w * value(c.i))

    def both(p: Column) -> Column:
        tall = F.transform(_weights(height, rows), lambda cells: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: mean(cells, lambda i: F.get(p, i * width + x).cast("double"))))
        return F.flatten(F.transform(tall, lambda row: F.transform(_weights(width, columns), lambda cells: mean(cells, lambda i: F.get(row, i)))))

    return A.let(plane, both)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey values 0 to 255 of colour values, with the usual 14-bit weights (fixed values), half up."""
    part = lambda x, k: F.floor(x) * k
    two = F.zip_with(r, g, lambda x, y: part(x, 4899) + part(y, 9617))
    return F.zip_with(two, b, lambda s, z: F.shiftright((s + part(z, 1868) + 8192).cast("long"), 14))


def quantile(values: Column, share: float) -> Column:
    """The value at ``share`` of the sorted values, between neighbours in proportion; null for none."""

    def at(v: Column) -> Column:
        place = F.lit(share) * (F.size(v) - 1)
        low = F.floor(place).cast("int")
        a, b = F.get(v, low).cast("double"), F.get(v, F.least(low + 1, F.size(v) - 1)).cast("double")
        return a + (b - a) * (place - low)

    return A.let(F.array_sort(values), at)


def figures(gray: Column) -> Column:
    """Mean, population deviation, 99th percentile, maximum and share above 3 of a plane."""

    def of(v: Column) -> Column:
        n = F.size(v)
        total = lambda value: F.aggregate(v, F.lit(0.0), lambda a, x: a + value(x.cast("double")))
        mean = total(lambda x: x) / n
        square = total(lambda x: x * x) / n
        return F.struct(
            mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), quantile(v, 0.99).alias("p99"), F.array_max(v).cast("double").alias("max"), (F.size(F.filter(v, lambda x: x > 3)) / n).alias("nonzero")
        )

    return A.let(gray, of)


def is_valid(gray: Column, mean: float = BLACK_MEAN, p99: float = BLACK_P99) -> Column:
    """False for a nearly black plane: both mean and 99th percentile at or below their bounds."""
    return A.let(figures(gray), lambda f: ~((f["mean"] <= mean) & (f["p99"] <= p99)))


def raw_metrics(gray: Column, size: tuple[int, int], to: tuple[int, int], share: float = ACTIVE) -> Column:
    """Figures of one raw grey frame: its upper rows (an even number of them), brought to a fixed size and rounded; another number of values is an error."""
    height, width = size
    rows = int(height * share / 2) * 2
    cut = F.slice(demanded(gray, height * width), 1, rows * width)
    return figures(F.transform(resampled(cut, (rows, width), to), lambda x: F.floor(x + 0.5)))


def prepared(frame: Column, size: tuple[int, int], to: tuple[int, int]) -> Column:
    """A frame with its lower rows blanked, at the model's size, with ``valid``."""

    def one(f: Column) -> Column:
        planes = {p: resampled(blanked(demanded(f[p], size[0] * size[1]), *size), size, to) for p in PLANES}

        def seen(g: Column) -> Column:
            gray = luma(*(top(g[p], *to) for p in PLANES))
            return F.struct(*(g[p].alias(p) for p in PLANES), is_valid(gray).alias("valid"))

        return A.let(F.struct(*(v.alias(p) for p, v in planes.items())), seen)

    return A.let(frame, one)


def clip(frames: Column, size: tuple[int, int], to: tuple[int, int], means: tuple[float, ...], spreads: tuple[float, ...]) -> Column:
    """A clip of ordered frames: ``mask`` (which are valid) and ``planes``, the standardised values of each colour, frame after frame.

    Frames that aren't valid take the nearest valid one's picture (ties: the
    earlier), but stay marked in the mask; a clip without a valid frame stays black.
    """

    def filled(all_: Column) -> Column:
        mask = F.transform(all_, lambda f: f.valid)
        shown = A.nearest_valid(all_, mask)
        plane = lambda s, p: F.flatten(F.transform(s, lambda f: f[p]))
        planes = lambda s: F.struct(*(A.standardized(plane(s, p), m, d).alias(p) for p, m, d in zip(PLANES, means, spreads)))
        return F.struct(mask.alias("mask"), A.let(shown, planes).alias("planes"))

    return A.let(F.transform(frames, lambda f: prepared(f, size, to)), filled)


# ------------------------------------------------------------------ augmentation

#: Ranges of the draws; fixed values.
JITTER = {"brightness": (0.8, 1.2), "contrast": (0.8, 1.2), "saturation": (0.8, 1.2), "hue": (-0.05, 0.05)}


def jitter_draw(key: Column, seed: str = "jitter") -> Column:
    """One draw for a clip: a factor for each transform, the order in which they come, and a roll of -1, 0 or 1."""
    fraction = lambda name: stable_fraction(F.concat_ws("|", F.lit(seed), F.lit(name), key.cast("string")))
    factors = [(F.lit(a) + fraction(n) * (b - a)).alias(n) for n, (a, b) in JITTER.items()]
    order = F.array_sort(F.array(*(F.struct(fraction(f"order {n}").alias("f"), F.lit(n).alias("n")) for n in JITTER)))
    return F.struct(*factors, F.transform(order, lambda x: x.n).alias("order"), (F.least(F.floor(fraction("roll") * 3), F.lit(2)) - 1).cast("int").alias("roll"))


def _byte(x: Column) -> Column:
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)))


def _blend(pixels: Column, other, factor: Column) -> Column:
    """Each colour as ``factor`` of itself and the rest of ``other`` (of the pixel), as whole values 0 to 255."""
    mix = lambda p, c: _byte(p[c].cast("double") * factor + other(p) * (1 - factor)).alias(c)
    return F.transform(pixels, lambda p: F.struct(*(mix(p, c) for c in PLANES)))


def _gray(p: Column) -> Column:
    """Grey of a pixel by the 16-bit weights (fixed values) that colour transforms use."""
    return F.shiftright((F.floor(p.r) * 19595 + F.floor(p.g) * 38470 + F.floor(p.b) * 7471 + 32768).cast("long"), 16).cast("double")


def _hue(pixels: Column, shift: Column) -> Column:
    """Pixels with their hue moved by a share of the circle; saturation and value stay."""

    def one(p: Column) -> Column:
        high, low = F.greatest(p.r, p.g, p.b).cast("double"), F.least(p.r, p.g, p.b).cast("double")

        def turned(x: Column) -> Column:
            span = F.when(x.high > x.low, x.high - x.low).otherwise(1.0)
            sixth = F.when(p.r == x.high, (p.g - p.b) / span).when(p.g == x.high, (p.b - p.r) / span + 2).otherwise((p.r - p.g) / span + 4)
            part = lambda n: F.pmod(F.lit(float(n)) + F.pmod(sixth / 6 + shift, F.lit(1.0)) * 6, F.lit(6.0))
            value = lambda n: x.high - (x.high - x.low) * F.greatest(F.lit(0.0), F.least(part(n), 4 - part(n), F.lit(1.0)))
            return F.struct(*(F.floor(value(n) + 0.5).alias(c) for c, n in (("r", 5), ("g", 3), ("b", 1))))

        return A.let(F.struct(high.alias("high"), low.alias("low")), turned)

    return F.transform(pixels, one)


def jittered(pixels: Column, draw: Column) -> Column:
    """Pixels (structs r, g, b) of one frame under a clip's draw: brightness, contrast, saturation and hue in its order."""

    def step(p: Column, name: Column) -> Column:
        def contrast(q: Column) -> Column:
            mean = F.floor(F.aggregate(q, F.lit(0.0), lambda a, x: a + _gray(x)) / F.greatest(F.size(q), F.lit(1)) + 0.5)
            return A.let(mean, lambda m: _blend(q, lambda _: m, draw["contrast"]))

        return (
            F.when(name == "brightness", _blend(p, lambda _: F.lit(0.0), draw["brightness"]))
            .when(name == "contrast", contrast(p))
            .when(name == "saturation", _blend(p, _gray, draw["saturation"]))
            .otherwise(_hue(p, draw["hue"]))
        )

    start = F.transform(pixels, lambda x: F.struct(*(F.floor(x[c]).alias(c) for c in PLANES)))
    return F.aggregate(draw["order"], start, step)


def rolled(frames: Column, by: Column) -> Column:
    """Frames shifted in a circle by -1, 0 or 1."""
    return F.when(by == 1, A.roll(frames, 1)).when(by == -1, A.roll(frames, -1)).otherwise(frames)
