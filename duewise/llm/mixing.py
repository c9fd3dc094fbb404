"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. ``targets`` shares a budget (150 % of all words) among sources by weight, capped at twice each source's size.
2. The budget is cut into equal blocks of ``block_words``; ``sainte_lague`` gives them to sources, and a source's
   blocks to its shards, by highest quotients. The quotas are integers and add up exactly.
3. A shard's documents are laid end to end in seeded order; its quota takes the first blocks of that stream, read
   round at most twice. A document's share of the taken blocks is interval arithmetic, so no block row is made.

Scale: one shuffle, of (doc_id, source, size) by (source, shard). A source has a shard per ``shard_words`` words, so a
hot source is spread; the number of shards is bounded by ``max_shards`` plus the number of sources. Only counts by source
and by shard reach the driver.

Edge cases: null or empty texts have size 0 and take 0; a null source is a source of its own, last in order; repeated
rows count each on its own; equal quotients go to the earlier source (code-point order) or the smaller shard; an empty
table gives an empty result; other columns are carried along by ``mix`` and never read.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duewise.llm.common import small, table, written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEAT = 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], budget: float, repeat: float = REPEAT) -> list[float]:
    """Words for each source: ``budget`` by weight, none above ``repeat`` times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > repeat * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(repeat * sizes[i])
        left -= sum(repeat * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """``seats`` dealt one by one to the highest quotient votes / (2 k + 1), k seats held, none above its cap.

    The first seats of each party, which every apportionment of this kind gives it, are dealt at once; the heap deals
    the rest, so the cost follows the number of parties, not of seats.
    """
    total = sum(votes)
    seats = min(seats, sum(caps))
    held = [0] * len(votes)
    if total > 0:
        slack = len(votes) / 2 + 1
        held = [min(c, max(0, math.floor(v / total * (seats - slack) - 0.5))) for v, c in zip(votes, caps, strict=True)]
    heap = [(-v / (2 * k + 1), i) for i, (v, k, c) in enumerate(zip(votes, held, caps, strict=True)) if k < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
    return held


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    repeat: int = REPEAT,
    block_words: int = 64,
    shard_words: int = 16_384,
    max_shards: int = 4_096,
    seed: int = 17,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source)."""
    spark = docs.sparkSession
    slim = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    per = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()
    per.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    names, sizes = [r["source"] for r in per], [r["n"] for r in per]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], budget * sum(sizes), repeat)
    shard_words = max(shard_words, math.ceil(sum(sizes) / max_shards))
    plan = spark.createDataFrame(
        [(s is None, s or "", n, float(t), max(1, math.ceil(n / shard_words))) for s, n, t in zip(names, sizes, goal, strict=True)],
        "no_source boolean, name string, source_size long, target double, shards int",
    )
    dealt = slim.withColumns({"no_source": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}).join(small(plan, len(per)), ["no_source", "name"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("shards")).cast("int"))
    shards = [tuple(r) for r in dealt.groupBy("no_source", "name", "shard").agg(F.sum("size").alias("n")).collect()]
    shards.sort(key=lambda r: (r[0], r[1].encode(), r[2]))
    by_source: dict[tuple, list[int]] = {}
    for k, r in enumerate(shards):
        by_source.setdefault((r[0], r[1]), []).append(k)
    blocks = sainte_lague(goal, round(sum(goal) / block_words), [math.ceil(repeat * n / block_words) for n in sizes])
    quota = [0] * len(shards)
    for s, q in zip(names, blocks, strict=True):
        own = by_source[(s is None, s or "")]
        for k, x in zip(own, sainte_lague([shards[k][3] for k in own], q, [math.ceil(repeat * shards[k][3] / block_words) for k in own]), strict=True):
            quota[k] = x
    quotas = spark.createDataFrame(
        [(*r, min(q * block_words, repeat * r[3])) for r, q in zip(shards, quota, strict=True)],
        "no_source boolean, name string, shard int, shard_size long, quota long",
    )
    dealt = dealt.join(small(quotas, len(shards)), ["no_source", "name", "shard"])
    stream = Window.partitionBy("no_source", "name", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("size").over(stream)
    whole = F.floor(F.col("quota") / F.greatest("shard_size", F.lit(1)))
    rest = F.col("quota") - whole * F.col("shard_size")
    begin = F.col("upto") - F.col("size")
    taken = F.col("size") * whole + F.greatest(F.lit(0), F.least("upto", rest) - begin)
    return dealt.withColumn("upto", end).select("doc_id", "source", "size", "source_size", "target", F.greatest(F.lit(0), taken).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix has them: each row none, one or more times, the whole number nearest to the share taken of its words.

    Rows without words stay as they are. Rows with one doc_id are dealt alike.
    """
    got = mix(docs, **options).select("doc_id", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int").alias("n"))
    got = written(got.groupBy(F.col("doc_id").alias("_id")).agg(F.max("n").alias("_n")))
    out = docs.join(small(got, got.count()), docs["doc_id"].eqNullSafe(got["_id"])).filter("_n > 0")
    return out.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).drop("_n", "_id")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
