"""The corpus pipeline: documents go through toxicity, line dedup, near-duplicate removal, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, and only those.

Edge cases: documents without text pass all stages and end with no ids; documents that line dedup empties go, as all their
lines stand elsewhere; of near duplicates the one with the smallest doc_id stays (nulls last, then the first row). Rows are told
apart by place, so rows that share or lack a doc_id are documents of their own, and of rows alike in everything one stays. A
null language or source is a value like others. Empty tables, and documents without any label, give an empty result and the
prior's verdicts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm import bpe, jaccard, lines, mixing, toxicity
from duewise.llm.common import small, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Bytes of a batch between JVM and Python. By number alone (10,000 rows) a batch of long texts takes tens of MB several times
#: over in each task, and an executor keeps that memory through the stages that follow.
BATCH_BYTES = 4 << 20


def slight(spark: SparkSession) -> None:
    """Bounds the session's batches by BATCH_BYTES, from here on, as stages are read after they return; a smaller bound stays."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, learned from the labels, doesn't call toxic."""
    slight(spark)
    docs = docs.select(*COLUMNS)
    scored = toxicity.Model.fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, less the lines that stand earlier in the corpus and less those that nothing is left of; n_chars follows."""
    left = lines.dedup(docs.select(*COLUMNS))
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) == "")
    return left.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of similar ones."""
    slight(spark)
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    found, _ = jaccard.join(rows.select(F.col("_row").alias("doc_id"), "text"))
    found = written(found.filter("n_links > 0").select(F.col("doc_id").alias("_row"), "component_id"))
    members = found.join(rows.select("_row", "doc_id"), "_row").select("component_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("at"))
    first = members.groupBy("component_id").agg(F.min("at").alias("at")).select(F.col("at._row").alias("_row"))
    others = written(found.select("_row").join(first, "_row", "left_anti"))
    return rows.join(small(others, others.count()), "_row", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: left out, once or twice."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with token ids, their number, and the digest of what they decode to."""
    slight(spark)
    operator = bpe.Operator(docs.select("text"), bpe.vocabulary_path())
    fields = {
        "n_tokens": ("long", lambda n, ids, tokens: n),
        "token_ids": ("array<int>", lambda n, ids, tokens: bpe.as_array(ids)),
        "decoded_sha256": ("string", lambda n, ids, tokens: hashlib.sha256(tokens.encode()).hexdigest()),
    }
    return operator.each(docs, fields, ["doc_id", "lang", "source"])


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates), ("mixing", mixture), ("bpe", encoded)]

#: No SQL expresses the learned and the encoding stages; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, written between them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
