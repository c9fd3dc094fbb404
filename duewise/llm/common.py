"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.storage import small, written

__all__ = ["ascii_lower", "frugal", "fresh", "small", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z alone lower-cased; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it (Spark ignores case)."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def hand_back() -> None:
    """Gives memory that this process has freed back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (batches to batches), handing memory back at its end: Python workers outlive their tasks and stages."""

    @functools.wraps(run)
    def spent(batches: Iterator) -> Iterator:
        yield from run(batches)
        hand_back()

    return spent
