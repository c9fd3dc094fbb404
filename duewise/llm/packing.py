"""Token-id output: best-fit-decreasing packing of tokenised documents into rows of one length.

Documents are encoded by a public byte-level vocabulary and end with ``end_id``. What is longer than a row is split: whole
rows, then a rest. The pieces are packed longest first, each into the open row with the least room that is enough; a segment
tree over room finds it in logarithmic time. A row holds its ids as fixed-width little-endian bytes (padded by ``end_id``),
the cumulative lengths of its segments, the places where positions start again, and each segment's document, the document's
number in its shard and the offset in it, so that ``unpack`` gives every document back, whatever doc_ids repeat or lack.

Scale: one map over the table, no shuffle. A task packs windows of about ``window_tokens`` ids, so its memory is bounded; the
room that is lost is that of the last rows of a window. The vocabulary is read on the driver from a path given as a
parameter and broadcast (its size is fixed).

Edge cases: null and empty texts are documents of the end id alone; a null doc_id stays null; rows that share or lack a doc_id are packed each on
its own; equally long pieces keep their order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import array
import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm.common import table

END_ID = 50_256
SCHEMA = "shard long, row int, n_tokens int, token_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_rows array<int>, doc_offsets array<int>"
MEMO = 400_000


class Room:
    """How many open rows have how much room, as a segment tree; finds the least room of at least so much."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, change: int) -> None:
        k = room + self.size
        while k:
            self.tree[k] += change
            k >>= 1

    def least(self, want: int) -> int:
        """The least room of ``want`` or more that some row has; -1 if none has."""
        k, tree = want + self.size, self.tree
        if tree[k]:
            return want
        while k & 1 or not tree[k + 1]:  # climb until a subtree to the right holds a row
            k >>= 1
            if not k:
                return -1
        k += 1
        while k < self.size:
            k = 2 * k if tree[2 * k] else 2 * k + 1
        return k - self.size


def pack(lengths: list[int], length: int) -> list[list[int]]:
    """Numbers of the pieces in each row, none longer than ``length``: longest first, each where it fits best."""
    room, rows, open_ = Room(length), [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        left = room.least(n)
        if left < 0:
            rows.append([])
            row, left = len(rows) - 1, length
        else:
            row = open_[left].pop()
            room.add(left, -1)
        rows[row].append(k)
        if left > n:
            open_.setdefault(left - n, []).append(row)
            room.add(left - n, 1)
    return rows


class Tokenizer:
    """Byte-level encoder in one worker; what a piece gives is remembered, as bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, code: str):
        self.find = regex.compile(pattern).findall
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.code, self.memo = code, {}

    def piece(self, piece: str) -> bytes:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        got = self.memo[piece] = array.array(self.code, self.encoding.encode_ordinary(piece)).tobytes()
        return got

    def ids(self, text: str | None) -> bytes:
        get, piece = self.memo.get, self.piece
        return b"".join([get(p) or piece(p) for p in self.find(text or "")])


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def packed(docs: DataFrame, path: str, pattern: str, *, length: int = 2_048, end_id: int = END_ID, window_tokens: int = 8_000_000, text: str = "text") -> DataFrame:
    """Rows of ``SCHEMA`` that hold all of ``docs`` (doc_id and ``text``)."""
    ranks = vocabulary(path)
    code = "H" if max(end_id, *ranks.values()) < 1 << 16 else "I"
    width = array.array(code).itemsize
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = Tokenizer(sent.value, pattern, code), array.array(code, [end_id]).tobytes()
        partition, shards = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal shards
            pieces = [(d, at, ids[at * width : (at + length) * width], k) for k, (d, ids) in enumerate(held) for at in range(0, len(ids) // width, length)]
            sizes = [len(p[2]) // width for p in pieces]
            rows = pack(sizes, length)
            for lo in range(0, len(rows), 500):
                part = rows[lo : lo + 500]
                ends = [np.cumsum([0, *(sizes[k] for k in row)]).astype(np.int32) for row in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition * 1_000_000 + shards] * len(part), pa.int64()),
                        pa.array(range(lo, lo + len(part)), pa.int32()),
                        pa.array([int(e[-1]) for e in ends], pa.int32()),
                        pa.array([b"".join([pieces[k][2] for k in row]) + end * (length - int(e[-1])) for row, e in zip(part, ends, strict=True)], pa.binary()),
                        pa.array(ends, pa.list_(pa.int32())),
                        pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
                        pa.array([[pieces[k][0] for k in row] for row in part], pa.list_(pa.int64())),
                        pa.array([[pieces[k][3] for k in row] for row in part], pa.list_(pa.int32())),
                        pa.array([[pieces[k][1] for k in row] for row in part], pa.list_(pa.int32())),
                    ],
                    names=["shard", "row", "n_tokens", "token_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_rows", "doc_offsets"],
                )
            shards += 1
            held.clear()

        total = 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.ids(t.as_py()) + end
                held.append((d, ids))
                total += len(ids) // width
                if total >= window_tokens:
                    yield from out()
                    total = 0
        if held:
            yield from out()

    return docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`")).mapInArrow(run, SCHEMA)


def matrix(rows: list, length: int = 2_048, kind: str = "<u2") -> np.ndarray:
    """The ids of collected rows as a matrix."""
    return np.stack([np.frombuffer(r["token_ids"], kind, length) for r in rows]) if rows else np.empty((0, length), kind)


def unpack(rows: list, kind: str = "<u2") -> list[tuple[int | None, list[int]]]:
    """(doc_id, ids with the end id) of every document in collected rows, pieces joined; for checks and readers."""
    pieces = []
    for r in rows:
        ids = np.frombuffer(r["token_ids"], kind)
        for k, (d, n, at) in enumerate(zip(r["doc_ids"], r["doc_rows"], r["doc_offsets"], strict=True)):
            pieces.append((r["shard"], n, at, d, ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()))
    whole: dict[tuple[int, int], tuple] = {}
    for shard, n, _, d, ids in sorted(pieces, key=lambda p: p[:3]):
        whole.setdefault((shard, n), (d, []))[1].extend(ids)
    return list(whole.values())


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of token ids."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
