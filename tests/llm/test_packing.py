import random

import public_tokenizers
import tiktoken

from duewise.llm import packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def best_fit(lengths, length):
    rooms, rows = [], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in range(len(rooms)) if rooms[r] >= lengths[k]]
        if not fits:
            rooms.append(length)
            rows.append([])
            fits = [len(rooms) - 1]
        r = min(fits, key=lambda r: rooms[r])
        rooms[r] -= lengths[k]
        rows[r].append(k)
    return sorted(sorted(lengths[k] for k in row) for row in rows)


def test_rows_equal_plain_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        length = rng.randint(1, 70)
        lengths = [rng.randint(1, length) for _ in range(rng.randint(0, 120))]
        rows = packing.pack(lengths, length)
        assert sorted(k for row in rows for k in row) == list(range(len(lengths)))
        assert all(sum(lengths[k] for k in row) <= length for row in rows)
        assert sum(length - sum(lengths[k] for k in row) for row in rows) == sum(length - sum(r) for r in best_fit(lengths, length))


def test_room_finds_the_least_that_is_enough():
    rng, length = random.Random(2), 37
    room, have = packing.Room(length), []
    for _ in range(400):
        x = rng.randint(0, length)
        have.append(x)
        room.add(x, 1)
        if rng.random() < 0.6:
            room.add(gone := have.pop(rng.randrange(len(have))), -1)
            assert 0 <= gone <= length
        want = rng.randint(0, length)
        assert room.least(want) == min((h for h in have if h >= want), default=-1)


def test_round_trip_of_whole_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "a" * 9000, "it's 12,345 été 日本語  \n\n x<|endoftext|>", "word " * 3000, *(" ".join(rng.choice(["the", "quick", "ñandú", "x1"]) for _ in range(rng.randint(0, 300))) for _ in range(60))]
    docs = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "no id", 1), (None, "b " * 400, 1), (None, "c " * 500, 1), (3, "d " * 600, 1), (3, "e " * 300, 1), (3, texts[3], 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, row int").repartition(3)
    rows = packing.packed(frame, PATH, PATTERN, length=128, window_tokens=2000).collect()
    library = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=packing.vocabulary(PATH), special_tokens={})
    want = sorted((repr(d), [*library.encode_ordinary(t or ""), packing.END_ID]) for d, t, _ in docs)
    assert sorted((repr(d), ids) for d, ids in packing.unpack(rows)) == want
    m = packing.matrix(rows, 128)
    assert m.shape == (len(rows), 128)
    for r, ids in zip(rows, m, strict=True):
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 128 and r["position_resets"] == r["cu_seqlens"][:-1]
        assert (ids[r["n_tokens"] :] == packing.END_ID).all()
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows)
    assert packing.packed(frame.limit(0), PATH, PATTERN).count() == 0
