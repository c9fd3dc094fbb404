"""Embedding near-duplicates through a pivot-permutation index.

Each vector is described by its nearest reference points in order (its permutation prefix). It stands in the inverted lists of
its first ``listed`` pivots; two vectors in a list that share at least ``shared`` of their first ``described`` pivots are
verified by their cosine in double precision. A pair that meets in several lists is counted in the one of the smallest pivot.

The reference points are the only sample, taken from the vectors with the smallest seeded hashes, four for each, so that no two
are near each other. Their number grows with the root of the number of vectors (``per_root`` times, at most ``most_pivots``), so
lists grow no faster. Every vector is indexed. Recall against brute force is measured in the tests.

Scale: exact copies are one entry that carries its number. Lists are cut into blocks of about ``block`` vectors, and every
two blocks of a list are compared in a task of their own, so a hot list is spread; what leaves a task is a count of links and
a spanning set of links, never all pairs.

Edge cases: a null label, and null, empty or zero vectors or ones with null or non-finite components, link with nothing and
are their own component; vectors of different lengths never link; repeated rows are copies; a null vec_id takes part, and a
component's id is its smallest vec_id that is there; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm.common import table, written
from duewise.llm.vectors import hashed_sample, matrix, usable
from duewise.operators.components import weak_components as components


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose(drawn: list[list[float]], pivots: int, apart: float = 0.6) -> list[list[float]]:
    """Up to ``pivots`` of the vectors, no two with a cosine over ``apart`` (loosened only if too few remain)."""
    if not drawn:
        return []
    size = max({len(v) for v in drawn}, key=[len(v) for v in drawn].count)
    x = unit(matrix([v for v in drawn if len(v) == size]))
    taken = [0]
    nearest = x @ x[0]
    while len(taken) < min(pivots, len(x)):
        free = np.flatnonzero(nearest < apart)
        free = free[~np.isin(free, taken)]
        if not len(free):
            break
        taken.append(int(free[0]))
        nearest = np.maximum(nearest, x @ x[free[0]])
    return x[taken].tolist()


def described(vectors: DataFrame, points: list[list[float]], count: int) -> DataFrame:
    """``vectors`` (column v) with ``near``: the numbers of the ``count`` nearest reference points, nearest first."""
    sent = vectors.sparkSession.sparkContext.broadcast(np.array(points))

    def run(frames):
        p = sent.value
        for frame in frames:
            near = pd.Series([[]] * len(frame), dtype=object)
            for size, at in frame.groupby(frame["v"].map(len)).indices.items():
                x = unit(matrix(frame["v"].iloc[at]))
                q = np.zeros((len(p), size))
                q[:, : min(size, p.shape[1])] = p[:, :size]
                order = np.argsort(-(x @ q.T), axis=1, kind="stable")[:, :count]
                for i, o in zip(at, order.astype(np.int32), strict=True):
                    near.iat[i] = o
            frame["near"] = near
            yield frame

    return vectors.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", near array<int>")


def links(entries: DataFrame, *, least: float, listed: int, shared: int, block: int) -> DataFrame:
    """Counts and spanning links from all lists. ``entries``: key, label, v, copies, near.

    Rows are (key, n, other): ``n`` linked vectors of a key in one pair of blocks, or a link to ``other`` with n 0.
    """
    dealt = entries.withColumn("size", F.size("v")).withColumn("pivot", F.explode(F.slice("near", 1, listed)))
    sizes = dealt.groupBy("label", "size", "pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = dealt.join(sizes, ["label", "size", "pivot"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        pivot, lo, hi = key[2:]
        frame = frame.sort_values("key", ignore_index=True)
        k, copies, own = (frame[c].to_numpy() for c in ("key", "copies", "own"))
        near = np.stack(frame["near"].to_numpy())
        here, column = np.unique(near, return_inverse=True)  # the pivots that occur
        column = column.reshape(near.shape)
        marks, lists = np.zeros((len(k), len(here)), np.float32), np.zeros((len(k), len(here)), np.float32)
        np.put_along_axis(marks, column, 1, 1)
        np.put_along_axis(lists, column[:, :listed], 1, 1)
        lists = lists[:, here < pivot]  # lists of smaller pivots
        x = unit(matrix(frame["v"]))
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        like = (marks[a] @ marks[b].T >= shared) & (lists[a] @ lists[b].T == 0)
        like &= x[a] @ x[b].T >= least
        if lo == hi:
            np.fill_diagonal(like, False)
        n = np.zeros(len(k), np.int64)
        n[a] = like @ copies[b]
        if lo != hi:
            n[b] += like.T @ copies[a]
        i, j = np.nonzero(like)
        i, j = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
        root = np.arange(len(k))
        while True:  # a spanning set of links: each vector to the smallest one its links reach here
            before = root.copy()
            np.minimum.at(root, j, before[i])
            np.minimum.at(root, i, before[j])
            root = root[root]
            if (root == before).all():
                break
        linked, tied = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(k)))
        none = np.full(len(linked), None, object)
        return pd.DataFrame({"key": np.append(k[linked], k[tied]), "n": np.append(n[linked], np.zeros(len(tied), np.int64)), "other": pd.array([*none, *k[root[tied]]], "Int64")})

    return dealt.select("label", "size", "pivot", "lo", "hi", "key", "v", "copies", "near", "own").groupBy("label", "size", "pivot", "lo", "hi").applyInPandas(run, "key long, n long, other long")


def near_duplicates(
    vectors: DataFrame, *, least: float = 0.93, per_root: float = 2.0, most_pivots: int = 4_096, listed: int = 5, described_by: int = 10, shared: int = 2, block: int = 512, seed: int = 5
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    good = F.col("label").isNotNull() & usable(F.col("v"))
    rows = written(rows.withColumn("key", F.when(good, F.xxhash64("label", "v"))))
    entries = written(rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")))
    total = entries.count()
    pivots = min(most_pivots, max(32, math.ceil(per_root * total**0.5)))
    points = choose(hashed_sample(entries, 4 * pivots, total, seed), pivots)
    if not points:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    count = min(described_by, len(points))
    found = written(links(described(entries, points, count), least=least, listed=min(listed, count), shared=min(shared, count), block=block))
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    parts = components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = entries.select("key", "rep", "copies").join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "component").join(counts, "key", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: near-duplicates among all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
