"""What the vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Whether a vector is there, has components, all of them finite numbers, and isn't zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & (F.size(v) > 0) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """A column of equally long vectors as a matrix of doubles."""
    return np.array(column.tolist() if hasattr(column, "tolist") else column, np.float64)


def hashed_sample(vectors: DataFrame, rows: int, total: int, seed: int) -> list[list[float]]:
    """Distinct vectors (column v) with the smallest seeded hashes, at most ``rows`` of ``total``; in a fixed order.

    The hash's bound is set for that many, so that no more leave the cluster than are kept, but for chance.
    """
    h = F.xxhash64(F.lit(seed), "v")
    bound = int(min(1.0, (rows + 3 * rows**0.5) / max(total, 1)) * (1 << 40))
    drawn = vectors.select("v", h.alias("h")).filter(F.shiftrightunsigned(h, 24) < bound).dropDuplicates(["h"]).collect()
    return [list(r["v"]) for r in sorted(drawn, key=lambda r: (r["h"] % (1 << 64), tuple(r["v"])))[:rows]]
