"""Encoded vectors as stored columns: one array per tier, or packed into exactly as many bits as they cost.

The tier map and the means of dropped angles belong to the table, not to its rows, and are kept by
the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektora.functions import kernels
from vektora.functions.vectors import doubles, ranges

CODES = "codes2 array<int>, codes4 array<int>, codes8 array<int>, halves array<float>, floats array<float>"
#: Column of each tier's stored values; tier 0 stores nothing.
COLUMN = {2: "codes2", 4: "codes4", 8: "codes8", 16: "halves", 32: "floats"}


def bits_per_vector(tiers: Sequence[int]) -> int:
    return int(sum(tiers))


def _angles(t, dim: int) -> np.ndarray:
    v = kernels.matrix(t.column("v"))
    return kernels.to_angles(v) if len(v) else np.zeros((0, dim - 1))


def _split(a: np.ndarray, tops: np.ndarray, tiers: np.ndarray) -> dict[int, np.ndarray]:
    """The stored values of each tier, its angles in order."""
    out = {b: kernels.angle_codes(a[:, tiers == b], tops[tiers == b], b).astype(np.int32) for b in (2, 4, 8)}
    return out | {16: a[:, tiers == 16].astype(np.float16), 32: a[:, tiers == 32].astype(np.float32)}


def _joined(parts: dict[int, np.ndarray], tops: np.ndarray, tiers: np.ndarray, means: np.ndarray, rows: int) -> np.ndarray:
    """The vectors of stored values."""
    a = np.tile(np.where(tiers == 0, means, 0.0), (rows, 1))
    for b in (2, 4, 8):
        a[:, tiers == b] = kernels.angle_middles(parts[b], tops[tiers == b], b)
    for b in (16, 32):
        a[:, tiers == b] = parts[b]
    return kernels.from_angles(a)


def _mapped(rows: DataFrame, f, ident: str, schema: str) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(f, f"id {kind}, {schema}").withColumnRenamed("id", ident)


def _vectors(table: DataFrame, ident: str, v: str) -> DataFrame:
    return table.select(F.col(f"`{ident}`").alias("id"), doubles(F.col(f"`{v}`")).alias("v")).filter("v is not null")


def encode(table: DataFrame, ident: str, v: str, dim: int, tiers: Sequence[int]) -> DataFrame:
    """(ident, codes2, codes4, codes8, halves, floats) of every vector that isn't null; tiers: bits of each of its dim - 1 angles."""
    tops, w = np.array(ranges(dim)), np.array(tiers)

    def run(batches):
        import pyarrow as pa

        for t in batches:
            parts = _split(_angles(t, dim), tops, w)
            cols = [kernels.lists(parts[b].astype(np.float32) if b >= 16 else parts[b]) for b in COLUMN]
            yield pa.RecordBatch.from_arrays([t.column("id"), *cols], names=["id", *COLUMN.values()])

    return _mapped(_vectors(table, ident, v), run, ident, CODES)


def decode(coded: DataFrame, ident: str, dim: int, tiers: Sequence[int], means: Sequence[float]) -> DataFrame:
    """(ident, v): the vectors that `encode` left, at length 1."""
    tops, w, m = np.array(ranges(dim)), np.array(tiers), np.array(means)

    def run(batches):
        import pyarrow as pa

        for t in batches:
            n = t.num_rows
            parts = {b: np.asarray(t.column(c).flatten()).reshape(n, -1) if (w == b).any() else np.zeros((n, 0)) for b, c in COLUMN.items()}
            yield pa.RecordBatch.from_arrays([t.column("id"), kernels.lists(_joined(parts, tops, w, m, n))], names=["id", "v"])

    return _mapped(coded.select(F.col(f"`{ident}`").alias("id"), *COLUMN.values()), run, ident, "v array<double>")


def pack(table: DataFrame, ident: str, v: str, dim: int, tiers: Sequence[int]) -> DataFrame:
    """(ident, packed): the stored values tier by tier, bit after bit, the last byte filled up with zeros."""
    tops, w = np.array(ranges(dim)), np.array(tiers)

    def run(batches):
        import pyarrow as pa

        for t in batches:
            parts, n = _split(_angles(t, dim), tops, w), t.num_rows
            bits = [((parts[b][:, :, None] >> np.arange(b - 1, -1, -1)) & 1).astype(np.uint8).reshape(n, -1) for b in (2, 4, 8)]
            bits += [np.unpackbits(np.ascontiguousarray(parts[b]).view(np.uint8).reshape(n, -1), axis=1) for b in (16, 32)]
            packed = np.packbits(np.hstack(bits), axis=1)
            yield pa.RecordBatch.from_arrays([t.column("id"), pa.array([x.tobytes() for x in packed], pa.binary())], names=["id", "packed"])

    return _mapped(_vectors(table, ident, v), run, ident, "packed binary")


def unpack(packed: DataFrame, ident: str, dim: int, tiers: Sequence[int], means: Sequence[float]) -> DataFrame:
    """(ident, v): the vectors that `pack` left, at length 1; a row of another size raises ValueError."""
    tops, w, m = np.array(ranges(dim)), np.array(tiers), np.array(means)
    size = -(-int(w.sum()) // 8)

    def run(batches):
        import pyarrow as pa

        for t in batches:
            cells = t.column("packed").to_pylist()
            if any(len(x) != size for x in cells):
                raise ValueError(f"packed vectors must have {size} bytes")
            n = len(cells)
            flat, at, parts = np.unpackbits(np.frombuffer(b"".join(cells), np.uint8).reshape(n, size), axis=1), 0, {}
            for b in COLUMN:
                k = int((w == b).sum())
                x = flat[:, at : at + k * b]
                at += k * b
                if b < 16:
                    parts[b] = (x.reshape(n, k, b).astype(np.int64) << np.arange(b - 1, -1, -1)).sum(axis=2)
                else:
                    parts[b] = np.packbits(x, axis=1).reshape(-1).view(np.float16 if b == 16 else np.float32).reshape(n, k).astype(np.float64)
            yield pa.RecordBatch.from_arrays([t.column("id"), kernels.lists(_joined(parts, tops, w, m, n))], names=["id", "v"])

    return _mapped(packed.select(F.col(f"`{ident}`").alias("id"), "packed"), run, ident, "v array<double>")
