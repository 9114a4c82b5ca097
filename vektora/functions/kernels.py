"""The codecs on matrices, for Arrow batches: the same results as the Column expressions, in time linear in the numbers.

Rows are vectors, all arithmetic is double. A kernel takes the vectors and their angles and gives
what is left of the vectors after encoding and decoding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from vektora.functions.codecs import TOP_GAP
from vektora.functions.vectors import CODEC_EPS, ranges


def matrix(column) -> np.ndarray:
    """An Arrow list column without nulls as a matrix of doubles; lists of different lengths raise ValueError."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if n and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def lists(m: np.ndarray):
    """A matrix as an Arrow list column."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int64) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))


def scaled(v: np.ndarray, eps: float = CODEC_EPS) -> np.ndarray:
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), eps)[:, None]


def to_angles(v: np.ndarray, eps: float = CODEC_EPS) -> np.ndarray:
    tails = np.sqrt(np.cumsum((v * v)[:, ::-1], axis=1)[:, ::-1])
    out = np.empty((len(v), v.shape[1] - 1))
    out[:, :-1] = np.arccos(np.clip(v[:, :-2] / np.maximum(tails[:, :-2], eps), -1.0, 1.0))
    turn = np.arctan2(v[:, -1], v[:, -2])
    out[:, -1] = np.where(turn < 0, turn + 2 * math.pi, turn)
    return out


def from_angles(a: np.ndarray, renormalise: bool = True) -> np.ndarray:
    v = np.ones((len(a), a.shape[1] + 1))
    np.cumprod(np.sin(a), axis=1, out=v[:, 1:])
    v[:, :-1] *= np.cos(a)
    return scaled(v) if renormalise else v


def log_sensitivities(a: np.ndarray, eps: float = CODEC_EPS) -> np.ndarray:
    out = np.zeros_like(a)
    np.cumsum(2 * np.log(np.maximum(np.abs(np.sin(a[:, :-1])), eps)), axis=1, out=out[:, 1:])
    return out


def angle_codes(a: np.ndarray, tops: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    """Bins of the angles; widths may differ by column."""
    levels = np.exp2(np.asarray(bits, np.float64))
    return np.clip(np.floor(np.clip(a, 0.0, tops - TOP_GAP) / tops * levels), 0, levels - 1).astype(np.int64)


def angle_middles(codes: np.ndarray, tops: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    return (codes + 0.5) * tops / np.exp2(np.asarray(bits, np.float64))


def shifted(v: np.ndarray, bits: int) -> np.ndarray:
    """The values left by the Cartesian quantiser whose decoder doesn't invert its encoder."""
    s = (2**bits - 1) / 2
    return (np.clip(np.rint(np.clip(v, -1.0, 1.0) * s + s / 2), 0, 2**bits - 1) + 0.5) / s - 1


def decoder(s, dim: int, stats) -> Callable[[np.ndarray, np.ndarray | None], np.ndarray]:
    """The kernel of a scheme; `stats` (means, rank) is needed by those that fill angles or go by rank."""
    tops = np.array(ranges(dim))
    means = np.array(stats.means) if stats else np.zeros(dim - 1)
    if s.decode is not None:
        return s.decode
    if s.family == "float":
        return lambda v, a: v
    if s.family == "cartesian":
        return lambda v, a: scaled(shifted(v, s.bits))
    if s.family == "truncated":

        def cut(v, a):
            out = np.zeros_like(v)
            out[:, : s.keep] = shifted(v[:, : s.keep], s.bits) if s.bits < 32 else v[:, : s.keep]
            return scaled(out)

        return cut
    if s.family == "tiers":
        return lambda v, a: from_angles(tiered(a, tops, s.tiers, means))
    if s.keep is None:
        return lambda v, a: from_angles(angle_middles(angle_codes(a, tops, s.bits), tops, s.bits))
    place = np.array(stats.rank) if s.by == "rank" else np.arange(dim - 1)
    kept, fill = place < s.keep, means if s.fill == "mean" else np.zeros(dim - 1)

    def clipped(v, a):
        out = np.tile(fill, (len(a), 1))
        out[:, kept] = angle_middles(angle_codes(a[:, kept], tops[kept], s.bits), tops[kept], s.bits)
        return from_angles(out)

    return clipped


def tiered(a: np.ndarray, tops: np.ndarray, tiers: Sequence[int], fill: np.ndarray) -> np.ndarray:
    w, out = np.array(tiers), np.array(a)
    out[:, w == 0] = fill[w == 0]
    out[:, w == 16] = a[:, w == 16].astype(np.float16)
    binned = (w > 0) & (w < 16)
    out[:, binned] = angle_middles(angle_codes(a[:, binned], tops[binned], w[binned]), tops[binned], w[binned])
    return out
