"""The registry of compression schemes: names, costs, equivalences, and how each decodes a vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vektora.functions import codecs, kernels
from vektora.functions.vectors import doubles, from_angles, literal, ranges, to_angles
from vektora.operators.allocation import greedy_tiers
from vektora.operators.calibration import Calibration

#: Fixed values of the registry.
CLIPS = (0, 20, 40, 50, 60, 80)
FLOAT_CLIPS = (20, 40, 50, 60, 80)
KEEPS = (30, 50, 70, 100)
BUDGETS = (1536, 3072, 6144, 9216, 12288)
WIDTHS = (8, 4, 2)


@dataclass(frozen=True)
class Scheme:
    """family: float, cartesian, truncated, angle, tiers, own. fill: mean or zero. by: position or rank.

    A scheme from outside has the family "own" and `decode`, a function of a matrix of vectors and
    one of their angles that gives the decoded vectors."""

    name: str
    family: str
    bits_per_vec: int
    bits: int = 32
    keep: int | None = None
    fill: str = ""
    by: str = ""
    tiers: tuple[int, ...] = ()
    decode: Callable | None = None

    @property
    def signature(self) -> tuple:
        """Equal for schemes that reconstruct every vector alike by definition."""
        return (self.family, self.bits, self.keep, self.fill, self.by, self.tiers if self.family == "tiers" else (), self.name if self.decode else "")


def registry(dim: int, stats: Calibration | None = None, budgets: Sequence[int] = BUDGETS, clips: Sequence[int] = CLIPS) -> list[Scheme]:
    """All schemes for `dim` numbers, in order. Without statistics, tiers are reckoned with equal sensitivities."""
    n = dim - 1
    sens = stats.sens if stats else [1.0] * n
    out = [Scheme("float32", "float", 32 * dim)]
    out += [Scheme(f"cart_int{b}", "cartesian", b * dim, b) for b in WIDTHS]
    out += [Scheme(f"angle_int{b}_uniform", "angle", b * n, b) for b in WIDTHS]

    def angle(name: str, keep: int, bits: int, fill: str, by: str) -> Scheme:
        if keep >= n:
            return Scheme(name, "angle", bits * n, bits)
        return Scheme(name, "angle", bits * keep, bits, keep, fill, by)

    kept = lambda p: int(round(n * (1.0 - p / 100)))
    for prefix, by in (("jac", "rank"), ("pos", "position")):
        out += [angle(f"{prefix}_clip_{p}pct", kept(p), 8, "mean", by) for p in clips]
    out += [angle(f"pos_clip_{p}pct_zero", kept(p), 8, "zero", "position") for p in clips]
    for p in clips:
        k = int(round(dim * (1.0 - p / 100)))
        out.append(Scheme(f"cart_clip_{p}pct", "cartesian", 8 * dim, 8) if k >= dim else Scheme(f"cart_clip_{p}pct", "truncated", 8 * k, 8, k))
    for p in FLOAT_CLIPS:
        k = int(round(dim * (1.0 - p / 100)))
        out.append(Scheme(f"cart_clip_{p}pct_f32", "truncated", 32 * k, 32, k))
    for b in budgets:
        t = greedy_tiers(sens, ranges(dim), b)
        out.append(Scheme(f"greedy_{b}b", "tiers", sum(t), tiers=tuple(t)))
    for b in WIDTHS:
        out += [angle(f"jac_trunc_int{b}_keep{p}pct", int(round(n * (p / 100))), b, "mean", "rank") for p in KEEPS]
    return out


def distinct(schemes: Sequence[Scheme]) -> tuple[list[Scheme], dict[str, str]]:
    """The schemes worth scoring, and alias -> the first scheme with the same signature.

    Schemes with tiers are never merged: they differ by budget even where their tiers happen to agree."""
    first: dict[tuple, str] = {}
    alias: dict[str, str] = {}
    out = []
    for s in schemes:
        key = (s.name,) if s.family == "tiers" else s.signature
        if key in first:
            alias[s.name] = first[key]
        else:
            first[key] = s.name
            out.append(s)
    return out, alias


def decoded(s: Scheme, v: Column, a: Column, dim: int, stats: Calibration | None) -> Column:
    """The vector that is left of `v` (with angles `a`) after encoding and decoding."""
    tops, n = ranges(dim), dim - 1
    if s.family == "float":
        return v
    if s.family == "cartesian":
        return codecs.cartesian(v, s.bits)
    if s.family == "truncated":
        return codecs.truncated(v, dim, s.keep, s.bits)
    means = literal(stats.means) if stats else literal([0.0] * n)
    if s.family == "tiers":
        return from_angles(codecs.angle_tiers(a, tops, s.tiers, means))
    if s.keep is None:
        return from_angles(codecs.angle_uniform(a, tops, s.bits))
    kept = [(stats.rank[i] if s.by == "rank" else i) < s.keep for i in range(n)]
    return from_angles(codecs.angle_clip(a, tops, s.bits, kept, means if s.fill == "mean" else literal([0.0] * n)))


def select(every: Sequence[Scheme], names: Sequence[str]) -> tuple[list[Scheme], list[str]]:
    """The named schemes in the registry's order, and the names it doesn't have."""
    wanted = set(names)
    return [s for s in every if s.name in wanted], sorted(wanted - {s.name for s in every})


def decoding(schemes: Sequence[Scheme], dim: int, stats: Calibration | None) -> Callable[[np.ndarray], Iterator[tuple[str, np.ndarray]]]:
    """A function that gives (name, decoded vectors) of every scheme for a matrix; angles are worked out once."""
    made = [(s.name, kernels.decoder(s, dim, stats)) for s in schemes]
    angles = any(s.family in ("angle", "tiers", "own") for s in schemes)

    def run(v):
        a = kernels.to_angles(v) if angles else None
        for name, f in made:
            yield name, f(v, a)

    return run


def decode_all(vectors: DataFrame, ident: str, v: str, dim: int, schemes: Sequence[Scheme], stats: Calibration | None, backend: str = "arrow") -> DataFrame:
    """(scheme, id, v) for every scheme, from one scan. Null vectors give no rows.

    backend "arrow" decodes whole batches, "columns" in expressions, whose time grows with the square
    of dim for angles."""
    base = vectors.select(F.col(ident).alias("id"), doubles(F.col(v)).alias("v")).filter("v is not null")
    if backend == "arrow":
        decode = decoding(schemes, dim, stats)

        def run(batches):
            import pyarrow as pa

            for t in batches:
                for at in range(0, t.num_rows, 2048):
                    part = t.slice(at, 2048)
                    for name, m in decode(kernels.matrix(part.column("v"))):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(m), pa.string()), part.column("id"), kernels.lists(m)], names=["scheme", "id", "v"])

        return base.mapInArrow(run, T.StructType([T.StructField("scheme", T.StringType()), T.StructField("id", base.schema["id"].dataType), T.StructField("v", T.ArrayType(T.DoubleType()))]))
    if any(s.family in ("angle", "tiers") for s in schemes):
        base = base.withColumn("a", to_angles(F.col("v"), dim))
    else:
        base = base.withColumn("a", F.lit(None).cast("array<double>"))
    each = F.array(*(F.struct(F.lit(s.name).alias("scheme"), decoded(s, F.col("v"), F.col("a"), dim, stats).alias("v")) for s in schemes))
    return base.select("id", F.explode(each).alias("x")).select("x.scheme", "id", "x.v")
