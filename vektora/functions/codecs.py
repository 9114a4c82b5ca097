"""Scalar codecs as Column expressions: quantise, reconstruct, account for bits.

Nothing is packed: codes are ints, `bits` are bookkeeping. All arithmetic is double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vektora.functions.vectors import CODEC_EPS, dot, from_angles, literal, norm, scaled  # noqa: F401

#: Angles are clipped this far below the end of their range before they are binned.
TOP_GAP = 1e-6
#: The tiers' bits.
TIERS = (0, 2, 4, 8, 16, 32)


def _clip(x: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda y: y if isinstance(y, Column) else F.lit(y)
    return F.least(F.greatest(x, lit(low)), lit(high))


def angle_code(t: Column, top: Column | float, bits: int | Column) -> Column:
    """Bin of an angle in [0, top) divided into 2^bits bins."""
    top = top if isinstance(top, Column) else F.lit(top)
    levels = F.lit(float(2**bits)) if isinstance(bits, int) else F.pow(F.lit(2.0), bits)
    return _clip(F.floor(_clip(t, 0.0, top - TOP_GAP) / top * levels), F.lit(0), levels - 1).cast("int")


def angle_middle(code: Column, top: Column | float, bits: int | Column) -> Column:
    """The middle of a bin."""
    top = top if isinstance(top, Column) else F.lit(top)
    levels = F.lit(float(2**bits)) if isinstance(bits, int) else F.pow(F.lit(2.0), bits)
    return (code + 0.5) * top / levels


def each_angle(a: Column, tops: Sequence[float], f) -> Column:
    """f(angle, top, position) over all angles."""
    last = len(tops) - 1
    return F.transform(a, lambda t, i: f(t, F.when(i == last, F.lit(tops[-1])).otherwise(F.lit(tops[0])), i))


def angle_codes(a: Column, tops: Sequence[float], bits: int) -> Column:
    return each_angle(a, tops, lambda t, top, i: angle_code(t, top, bits))


def angle_uniform(a: Column, tops: Sequence[float], bits: int) -> Column:
    """Angles after quantisation, all with the same bits."""
    return each_angle(a, tops, lambda t, top, i: angle_middle(angle_code(t, top, bits), top, bits))


def angle_widths(a: Column, tops: Sequence[float], widths: Sequence[int]) -> Column:
    """Angles after quantisation with their own widths; a width of 0 gives the middle of the range."""
    w = F.array(*(F.lit(int(b)) for b in widths))
    return each_angle(a, tops, lambda t, top, i: angle_middle(angle_code(t, top, F.element_at(w, i + 1)), top, F.element_at(w, i + 1)))


def angle_clip(a: Column, tops: Sequence[float], bits: int, kept: Sequence[bool], fill: Column) -> Column:
    """Kept angles quantised, the others replaced by those of `fill` (an array)."""
    k = F.array(*(F.lit(bool(x)) for x in kept))
    return each_angle(a, tops, lambda t, top, i: F.when(F.element_at(k, i + 1), angle_middle(angle_code(t, top, bits), top, bits)).otherwise(F.element_at(fill, i + 1)))


def half(x: Column) -> Column:
    """x rounded to IEEE half precision (for |x| < 65520), ties to even."""
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))), F.lit(-14)).cast("double") - 10)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.rint(x / step) * step)


def angle_tiers(a: Column, tops: Sequence[float], tiers: Sequence[int], fill: Column) -> Column:
    """Angles with their tiers' bits: 0 takes the fill, 2 to 8 are binned, 16 is half precision, 32 is kept."""
    w = F.array(*(F.lit(int(b)) for b in tiers))

    def one(t, top, i):
        b = F.element_at(w, i + 1)
        out = F.when(b == 0, F.element_at(fill, i + 1)).when(b == 16, half(t)).when(b == 32, t)
        for n in (2, 4, 8):
            out = out.when(b == n, angle_middle(angle_code(t, top, n), top, n))
        return out

    return each_angle(a, tops, one)


def shifted_codes(v: Column, bits: int) -> Column:
    """Codes of the Cartesian quantiser whose offset is half of what its decoder assumes."""
    s = (2**bits - 1) / 2
    return F.transform(v, lambda x: _clip(F.rint(_clip(x, -1.0, 1.0) * s + s / 2), 0.0, float(2**bits - 1)).cast("int"))


def shifted_values(codes: Column, bits: int) -> Column:
    s = (2**bits - 1) / 2
    return F.transform(codes, lambda q: (q + 0.5) / s - 1)


def cartesian(v: Column, bits: int) -> Column:
    """Quantised and reconstructed at length 1 (mode "reference": the decoder doesn't invert the encoder)."""
    return scaled(shifted_values(shifted_codes(v, bits), bits))


def cartesian_centred(v: Column, bits: int) -> Column:
    """The same number of levels over [-1, 1], properly inverted; kept apart from `cartesian`."""
    s = (2**bits - 1) / 2
    return scaled(F.transform(v, lambda x: F.rint(_clip(x, -1.0, 1.0) * s + s) / s - 1))


def symmetric_int8(v: Column) -> Column:
    return scaled(F.transform(v, lambda x: F.rint(_clip(x, -1.0, 1.0) * 127) / 127))


def truncated(v: Column, dim: int, keep: int, bits: int = 32) -> Column:
    """The first `keep` coordinates, quantised below 32 bits, the rest zero, at length 1."""
    head = F.slice(v, 1, keep)
    if bits < 32:
        head = shifted_values(shifted_codes(head, bits), bits)
    return scaled(F.concat(head, F.array_repeat(F.lit(0.0), dim - keep)))


def largest_residual(v: Column, stage: Column) -> Column:
    return F.array_max(F.zip_with(v, stage, lambda x, y: F.abs(x - y)))


def residual_scale(largest: Column) -> Column:
    """The width of an int8 step that reaches the largest residual."""
    return F.greatest(largest, F.lit(SMALLEST)) / 127


def with_residual(v: Column, stage: Column, largest: Column | None = None, renormalise: bool = True) -> Column:
    """stage plus the int8-coded rest; the codes' scale comes from `largest` (null: the vector's own).

    At length 1 with renormalise. Where nothing is left to code, stage is the result."""
    most = largest_residual(v, stage) if largest is None else largest
    coded = F.zip_with(v, stage, lambda x, y: F.struct(y.alias("y"), (x - y).alias("r")))
    out = F.element_at(F.transform(F.array(residual_scale(most)), lambda s: F.transform(coded, lambda z: z["y"] + _clip(F.rint(z["r"] / s), -127.0, 127.0) * s)), 1)
    out = F.when(most < SMALLEST, stage).otherwise(out)
    return scaled(out, SMALLEST) if renormalise else out


SMALLEST = 1e-12
