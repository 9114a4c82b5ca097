"""The modules of this subpackage that hold QUERIES and ORACLES."""

from __future__ import annotations

import importlib

MODULES = ("p2_near_duplicates", "p3_clusters", "p4_chunks", "p5_neighbours", "p6_sample", "p7_encoding", "p8_mixture", "p9_quality")


def catalogue() -> list:
    return [importlib.import_module(f"vektora.llm.{m}") for m in MODULES]
