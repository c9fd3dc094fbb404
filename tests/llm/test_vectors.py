import math

import duckdb
import numpy as np
import pytest

from duewise.llm import neighbours, pivots

SF = "/root/testdata/sf0.01"
ODD = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 8, 1), (9003, [1.0, None] + [0.0] * 6, 1), (9004, [math.nan] * 8, 1), (9005, [math.inf] * 8, 1), (9006, [1.0] * 3, 1), (9007, [1.0] * 8, None), (None, [1.0] + [0.5] * 7, 1)]


def rows(seed, n=300, dims=8):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, dims))
    x = np.vstack([base[rng.integers(40, size=n)] + rng.standard_normal((n, dims)) * rng.choice([0.02, 0.1, 0.25], size=(n, 1)), rng.standard_normal((n, dims)) * 3]).astype(np.float32)
    x[5] = x[6] = x[7]
    return [(k, [float(c) for c in v], int(k % 2)) for k, v in enumerate(x)] + [(7, [float(c) for c in x[7]], 1)] + ODD


def ok(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def brute_links(data, least=0.93):
    n, parent = [0] * len(data), list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, v, a) in enumerate(data):
        for j in range(i):
            w, b = data[j][1:]
            if a is not None and a == b and ok(v) and ok(w) and len(v) == len(w) and np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w)) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _, _) in enumerate(data):
        ids.setdefault(find(i), []).append(d)
    least_id = lambda i: min((x for x in ids[find(i)] if x is not None), default=None)
    return [(d, n[i], least_id(i), d is not None and d == least_id(i)) for i, (d, _, _) in enumerate(data)]


@pytest.mark.parametrize("block", [512, 40])
def test_pivot_links_against_brute_force(spark, block):
    data = rows(1)
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in pivots.near_duplicates(frame, block=block).collect()), key=repr)
    want = sorted(brute_links([(d, v and [None if c is None else float(np.float32(c)) for c in v], a) for d, v, a in data]), key=repr)
    assert len(got) == len(want)
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.95 * len(want)


def test_pivot_links_on_the_table(spark):
    data = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall()
    got = sorted(tuple(r) for r in pivots.op5_pivots(spark, SF).collect())
    assert got == sorted(brute_links(data))


def test_neighbours_recall_ranks_and_odd_rows(spark):
    data = rows(2)
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = neighbours.search(frame, frame.filter("vec_id % 20 = 0"), block=200, chunk=10).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    usable = [(d, np.array(v, float)) for d, v, _ in data if d is not None and ok(v)]
    asked = {d: v for d, v in usable if d % 20 == 0}
    assert set(by) == {d for d in asked if len(asked[d]) == 8}
    hit = total = 0
    for d, found in by.items():
        q = asked[d]
        best = sorted(((-float(q @ v), e) for e, v in usable if e != d and len(v) == len(q)))[:20]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        hit += len({e for _, e in best} & {r["vec_id"] for r in found})
        total += len({e for _, e in best})
        for r in found:
            assert any(e == r["vec_id"] and abs(float(q @ v) - r["score"]) < 1e-9 for e, v in usable)
    assert hit >= 0.9 * total


def test_neighbours_recall_on_the_table(spark):
    x = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    m, ids = np.array([v for _, v in x], float), np.array([i for i, _ in x])
    got = {}
    for r in neighbours.op8_neighbours(spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.argsort(-s)[:20]]) & got[q])
    assert hit >= 0.9 * 20 * (ids % 20 == 0).sum()


def planted(n=20_000, pairs=1_000, dims=64):
    """Unit vectors without structure, and for the first of them one more at a cosine of 0.93 to 0.96."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((n, dims)))
    a, c = base[:pairs], rng.uniform(0.9301, 0.96, (pairs, 1))
    off = rng.standard_normal((pairs, dims))
    return np.vstack([base, a * c + unit(off - (off * a).sum(1, keepdims=True) * a) * np.sqrt(1 - c * c)])


def test_planted_neighbours_are_linked(spark, tmp_path):
    import pandas as pd

    x = planted()
    pd.DataFrame({"vec_id": range(len(x)), "embedding": list(x), "label": 1}).to_parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in pivots.op5_pivots(spark, str(tmp_path)).collect()}
    linked = [got[k]["component_id"] == got[20_000 + k]["component_id"] for k in range(1_000)]
    assert sum(linked) >= 990
    assert sum(r["n_links"] for r in got.values()) == 2 * sum(linked)  # nothing else is that near


def test_pivots_keep_lists_short():
    x = planted()
    points = np.array(pivots.choose(x[:1_160].tolist(), 290))
    order = np.argsort(-(x @ points.T), axis=1)[:, :10]
    counts = np.bincount(order[:, :5].ravel())
    assert len(points) == 290 and (counts**2).sum() < 0.15 * len(x) ** 2  # entries compared, of all pairs


def searched(x, asked=40, k=20, dims=32, sure=0.9):
    """Recall against brute force, and share of vectors verified."""
    index = neighbours.Index(np.arange(len(x)), x, neighbours.Projection(x.shape[1], dims, 3, np.linalg.norm(x, axis=1).max()))
    hit = 0
    for r, ids, _ in index.search(np.arange(asked), x[:asked], np.full(asked, np.nan), k, neighbours.quantile(sure, dims)):
        s = x @ x[r]
        s[r] = -np.inf
        hit += len(set(np.argsort(-s)[:k]) & set(ids))
    return hit / asked / k, index.verified / asked / len(x)


def test_share_of_vectors_that_are_verified():
    rng = np.random.default_rng(1)
    recall, share = searched(rng.standard_normal((300, 64))[rng.integers(300, size=16_384)] + 0.3 * rng.standard_normal((16_384, 64)))
    assert recall >= 0.95 and share <= 0.05
    recall, share = searched(np.array([r[0] for r in duckdb.sql("select embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchall()], float))
    assert recall >= 0.9 and share <= 0.6  # vectors without structure


def test_cells_hold_their_points():
    points = np.random.default_rng(2).standard_normal((500, 3))
    cells = neighbours.Cells(points, 16)
    home = cells.of(points)
    assert cells.count == 16 and np.bincount(home, minlength=16).min() > 15
    for p in points[:50]:
        gaps = cells.gaps(p)
        assert gaps[cells.of(p[None])[0]] == 0
        for c in range(16):
            assert gaps[c] <= ((points[home == c] - p) ** 2).sum(axis=1).min() + 1e-9
    assert set(neighbours.Cells(np.ones((9, 2)), 8).of(np.ones((4, 2)))) == {0}


def test_few_candidates_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in neighbours.search(frame, frame.filter("vec_id = 0")).collect()] == [(0, 1, 1, 4.0), (0, 2, 2, 3.0)]
    assert neighbours.search(frame.limit(0), frame.limit(0)).count() == 0
    assert pivots.near_duplicates(frame.limit(0)).count() == 0


def test_chi_square():
    assert abs(float(neighbours.chi_square(15.507, 8)) - 0.95) < 1e-4
