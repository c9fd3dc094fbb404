"""Approximate nearest neighbours: low-dimensional stable projections in kd-trees, with a chi-square stopping test.

Largest inner products become smallest distances by one more dimension that makes all vectors equally long. Vectors are
projected on ``dims`` Gaussian directions (2-stable: a projected distance, squared and divided by the true one, follows a
chi-square law with ``dims`` degrees of freedom). A kd-tree over the projections deals all rows to cells; inside a cell another
one has the leaves. A query takes its projected neighbours in growing distance, verifies them by true inner products in double
precision, and stops where a vector at its k-th best distance would, with probability ``sure``, have been projected nearer.

Scale: every row is indexed. The cells' planes are fitted on at most about ``fit_rows`` rows (those with the smallest seeded
hashes); there are up to ``most_cells`` of them, and a cell of more than ``block`` rows is cut by a hash, so copies of one
vector don't make a large task. Queries go in two rounds, in chunks: first to their own cell, then, with the bound found there,
only to cells that the stopping test doesn't rule out. Data rows are sent once for each chunk that wants their cell. On
vectors without structure the test rules out few cells, and some 30 % of all vectors are verified; see the README.

Edge cases: rows without vec_id, and null, empty or zero vectors or ones with null or non-finite components, take no part, as
query or candidate; a row with the query's vec_id is the query's own; a repeated query is answered once; repeated candidates
count each on its own; ties go to the smaller vec_id; vectors of another length than the query's are no candidates; fewer
candidates than k are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duewise.llm.common import table, written
from duewise.llm.vectors import hashed_sample, matrix, usable


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function of the chi-square law with an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    return 1 - np.exp(-half) * sum(half**j / math.factorial(j) for j in range(dims // 2))


def quantile(sure: float, dims: int) -> float:
    """Where the chi-square law reaches ``sure``."""
    low, high = 0.0, 20.0 * dims
    for _ in range(60):
        half = (low + high) / 2
        low, high = (half, high) if chi_square(half, dims) < sure else (low, half)
    return high


def kd_tree(points: np.ndarray, leaf: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of a kd-tree, halved at medians of the widest side: order of the points, starts, and corners of the leaves' boxes."""
    order, starts, lows, highs = [], [0], [], []
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        low, high = points[at].min(axis=0), points[at].max(axis=0)
        if len(at) <= leaf or (low == high).all():
            order.append(at)
            starts.append(starts[-1] + len(at))
            lows.append(low)
            highs.append(high)
        else:
            by = points[at, int(np.argmax(high - low))]
            at = at[np.argsort(by, kind="stable")]
            todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return np.concatenate(order), np.array(starts), np.array(lows), np.array(highs)


class Projection:
    """Gaussian directions for vectors of one length, of which the longest has norm ``longest``."""

    def __init__(self, size: int, dims: int, seed: int, longest: float):
        self.directions, self.longest = np.random.default_rng(seed).standard_normal((size + 1, dims)), longest

    def data(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.longest
        return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))[:, None]]) @ self.directions

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))]) @ self.directions


class Cells:
    """Planes that deal projected points to cells, halved at medians of a sample."""

    def __init__(self, points: np.ndarray, cells: int):
        self.planes: list[tuple[int, float] | None] = []  # a full binary tree in level order
        todo = [points]
        for _ in range(max(0, math.ceil(math.log2(max(cells, 1))))):
            below = []
            for part in todo:
                if len(part) < 2 or (part == part[0]).all():
                    self.planes.append(None)
                    below += [part, part[:0]]
                    continue
                side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                middle = float(np.median(part[:, side]))
                self.planes.append((side, middle))
                below += [part[part[:, side] <= middle], part[part[:, side] > middle]]
            todo = below
        self.count = len(todo)

    def of(self, points: np.ndarray) -> np.ndarray:
        """Each point's cell."""
        at = np.zeros(len(points), np.int64)
        for _ in range(self.count.bit_length() - 1):
            side = np.array([p[0] if p else 0 for p in self.planes])[at]
            middle = np.array([p[1] if p else np.inf for p in self.planes])[at]
            at = 2 * at + 1 + (points[np.arange(len(points)), side] > middle)
        return at - (self.count - 1)

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point from each cell's box; infinite for cells that nothing is dealt to."""
        out = []

        def down(k: int, gap: np.ndarray) -> None:
            if k >= len(self.planes):
                out.append(float((gap * gap).sum()))
            elif (plane := self.planes[k]) is None:
                down(2 * k + 1, gap)
                down(2 * k + 2, np.full_like(gap, np.inf))
            else:
                side, middle = plane
                off = point[side] - middle
                for child, beyond in ((2 * k + 1, off > 0), (2 * k + 2, off <= 0)):
                    far = gap
                    if beyond:
                        far = gap.copy()
                        far[side] = max(far[side], abs(off))
                    down(child, far)

        down(0, np.zeros(len(point)))
        return np.array(out)


class Index:
    """kd-tree of a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projection: Projection):
        self.projection, points = projection, projection.data(x)
        order, self.starts, self.low, self.high = kd_tree(points)
        self.points, self.ids, self.x, self.verified = points[order], ids[order], x[order], 0
        self.squares = (self.points * self.points).sum(axis=1)

    def search(self, own: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, limit: float):
        """(query row, vec_id, inner product) of up to ``k`` best found for each query; ``own``: the queries' vec_ids.

        ``bound`` is a k-th best inner product known before (or nan), ``limit`` the quantile at which the test stops.
        """
        projected, long = self.projection.queries(q), np.linalg.norm(q, axis=1)
        sizes, longest = np.diff(self.starts), self.projection.longest
        for r in range(len(q)):
            gap = np.maximum(0, np.maximum(self.low - projected[r], projected[r] - self.high))
            reach = (gap * gap).sum(axis=1)
            ids, scores = np.empty(0, np.int64), np.empty(0)

            def cut() -> float:
                """Squared projected distance from which the test stops."""
                best = scores[k - 1] if len(scores) >= k else -np.inf  # noqa: B023
                best = best if np.isnan(bound[r]) else max(best, bound[r])  # noqa: B023
                return np.inf if best == -np.inf else max(2 - 2 * best / (longest * long[r]), 1e-12) * limit  # noqa: B023

            def verify(rows: np.ndarray) -> None:
                nonlocal ids, scores
                rows = rows[self.ids[rows] != own[r]]  # noqa: B023
                self.verified += len(rows)
                found = self.x[rows] @ q[r]  # noqa: B023
                if len(scores) == k:
                    good = found >= scores[-1]
                    rows, found = rows[good], found[good]
                ids, scores = np.append(ids, self.ids[rows]), np.append(scores, found)
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]

            near, p = np.flatnonzero(np.repeat(reach <= cut(), sizes)), projected[r]
            apart = self.squares[near] - 2 * ((self.points @ p)[near] if 2 * len(near) > len(self.points) else self.points[near] @ p) + p @ p
            done, share = -np.inf, max(k, 64) / max(len(near), 1)
            while len(near) and done < (end := cut()):  # projected neighbours in growing distance, more each time
                step = min(end, np.partition(apart, int(share * len(apart)))[int(share * len(apart))] if share < 1 else np.inf)
                verify(near[(apart > done) & (apart <= step)])
                if step == np.inf:
                    break
                done, share = step, share * 2
            yield r, ids, scores


def asked_of(data: DataFrame, queries: DataFrame, sent, k: int, limit: float, dims: int, seed: int, block: int, chunk: int) -> DataFrame:
    """(query_id, vec_id, score) of the best in each block of the cells that ``queries`` (id, v, size, cell, bound) go to."""
    asks = queries.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    holds = data.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("subs"))
    both = written(asks.join(holds, ["size", "cell"]))
    part = lambda name: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    rows = data.join(both, ["size", "cell"]).withColumns({"sub": part("subs"), "chunk": every("chunks"), "asks": F.lit(False), "bound": F.lit(None).cast("double")})
    asked = queries.join(both, ["size", "cell"]).withColumns({"chunk": part("chunks"), "asks": F.lit(True)}).withColumn("sub", every("subs"))
    names = ["size", "cell", "sub", "chunk", "asks", "id", "v", "bound"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        asks = frame["asks"].to_numpy()
        if asks.any() and not asks.all():
            own, bound = frame["id"].to_numpy()[asks], frame["bound"].to_numpy(float, na_value=np.nan)[asks]
            index = Index(frame["id"].to_numpy()[~asks], matrix(frame["v"][~asks]), Projection(key[0], dims, seed, sent.value[0][key[0]]))
            for r, ids, scores in index.search(own, matrix(frame["v"][asks]), bound, k, limit):
                out["query_id"].append(np.full(len(ids), own[r]))
                out["vec_id"].append(ids)
                out["score"].append(scores)
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, np.float64 if c == "score" else np.int64) for c, v in out.items()})

    return rows.select(names).unionByName(asked.select(names)).groupBy("size", "cell", "sub", "chunk").applyInPandas(run, "query_id long, vec_id long, score double")


def search(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, dims: int = 32, sure: float = 0.9, block: int = 16_384, chunk: int = 512, most_cells: int = 4_096, fit_rows: int = 16_384, seed: int = 3
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` best of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        return df.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("size", F.size("v"))

    data, asked = written(clean(vectors)), written(clean(queries).dropDuplicates(["id"]))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = {r["size"]: r["longest"] for r in data.groupBy("size").agg(F.max(norm).alias("longest")).collect()}
    n, limit = data.count(), quantile(sure, dims)
    cells = {}
    by_size: dict[int, list] = {}
    for v in hashed_sample(data, fit_rows, n, seed):
        by_size.setdefault(len(v), []).append(v)
    for size, some in by_size.items():
        cells[size] = Cells(Projection(size, dims, seed, longest[size]).data(np.array(some)), min(most_cells, len(some) // 4, math.ceil(n / block)))
    sent = spark.sparkContext.broadcast((longest, cells))

    def dealt(to: str):
        def run(frames):
            longest, cells = sent.value
            for frame in frames:
                out = []
                for size, at in frame.groupby("size").indices.items():
                    part = frame.iloc[at].copy()
                    if size not in longest:
                        continue
                    made = Projection(size, dims, seed, longest[size])
                    points = (made.data if to == "data" else made.queries)(matrix(part["v"]))
                    tree = cells.get(size)
                    home = tree.of(points) if tree else np.zeros(len(points), np.int64)
                    if to == "others":  # all cells that the test doesn't rule out, but for the query's own
                        long = np.linalg.norm(matrix(part["v"]), axis=1)
                        cut = np.maximum(2 - 2 * part["bound"].to_numpy(float, na_value=-np.inf) / (longest[size] * long), 1e-12) * limit
                        home = [[int(c) for c in np.flatnonzero(tree.gaps(p) < e) if c != h] if tree else [] for p, e, h in zip(points, cut, home, strict=True)]
                    out.append(part.assign(cell=pd.Series(list(home), index=part.index, dtype=object) if to == "others" else home))
                if out:
                    yield pd.concat(out)

        return run

    schema = "id long, v array<double>, size int, cell long"
    data = written(data.mapInPandas(dealt("data"), schema))
    home = written(asked.mapInPandas(dealt("queries"), schema).withColumn("bound", F.lit(None).cast("double")))
    options = (k, limit, dims, seed, block, chunk)
    first = written(asked_of(data, home, sent, *options))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    others = home.select("id", "v", "size").join(bounds, "id", "left").select("id", "v", "size", "bound").mapInPandas(dealt("others"), "id long, v array<double>, size int, bound double, cell array<long>")
    found = first.unionByName(asked_of(data, written(others.withColumn("cell", F.explode("cell"))), sent, *options))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the twenty best of every twentieth embedding."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
