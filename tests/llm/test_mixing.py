import heapq
import random
import re

import pytest

from duewise.llm import mixing


def dealt_one_by_one(votes, seats, caps):
    held = [0] * len(votes)
    heap = [(-v, i) for i, (v, c) in enumerate(zip(votes, caps, strict=True)) if c]
    heapq.heapify(heap)
    for _ in range(min(seats, sum(caps))):
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
    return held


def test_quotas_equal_dealing_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 12)
        votes = [rng.choice([0, 1, 5, 5, rng.random() * 100]) for _ in range(n)]
        caps = [rng.randint(0, 60) for _ in range(n)]
        seats = rng.randint(0, 200)
        got = mixing.sainte_lague(votes, seats, caps)
        assert got == dealt_one_by_one(votes, seats, caps) or sum(votes) == 0
        assert sum(got) == min(seats, sum(caps))


def test_targets_stop_at_twice_the_size_and_share_the_excess():
    assert mixing.targets([10, 100, 100], [5, 2, 1], 210) == pytest.approx([20, 2 * 190 / 3, 190 / 3])
    assert mixing.targets([], [], 0) == []
    assert sum(mixing.targets([1, 1], [5, 2], 3)) == 3


def brute_targets(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, x in docs if x == s) for s in names]
    return {s: (n, t) for s, n, t in zip(names, sizes, mixing.targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(sizes)), strict=True)}


def test_mix_near_targets_and_reruns(spark):
    rng = random.Random(2)
    docs = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 300))), rng.choice(["a", "é", "z", "Z", None, "hot", "hot", "hot"])) for k in range(600)]
    docs += [(900, None, "a"), (901, "  ", "a"), (902, "x\x0by\x1cz\xa0q", "a"), (3, docs[3][1], docs[3][2]), (None, "a b", "a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    options = {"block_words": 8, "shard_words": 2000}
    got = mixing.mix(frame, **options).collect()
    assert len(got) == len(docs)
    want = brute_targets(docs)
    for s, (n, target) in want.items():
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {n} and {round(r["target"], 6) for r in own} == {round(target, 6)}
        assert abs(sum(r["taken"] for r in own) - target) <= max(16, 0.01 * target)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(frame.repartition(5), **options).collect()))
    rows = mixing.mixed(frame.withColumn("size", frame["doc_id"]), **options)
    assert rows.columns == ["doc_id", "text", "source", "size"] and rows.filter("doc_id = 900").count() == 1
    assert mixing.mix(frame.limit(0)).count() == 0
