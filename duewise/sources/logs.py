"""Logs, cycle caches and curves on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.functions import scalars as S
from duewise.schema import FRAGMENTS, OPERATIONS
from duewise.sources.atomic import RecordError, missing_columns, read_text_csv


def nested(fragments: DataFrame) -> DataFrame:
    """Operations with their fragments inside, in the order they happened (schema OPERATIONS plus component and op_seq)."""
    part = F.struct("uid", "amount_cents", "issue_index", "due_index", "issue_ordinal", "due_ordinal")
    legs = fragments.groupBy("component", "op_seq", "kind", "day_index", "op_amount", "payer", "intermediary", "payee", "bilateral", "pmr_cents", "nodes", "leg", "edge_id").agg(F.sort_array(F.collect_list(F.struct("frag_seq", part.alias("f")))).alias("fs"))
    legs = legs.withColumn("fs", F.transform("fs", lambda x: x["f"]))
    ops = legs.groupBy("component", "op_seq", "kind", "day_index", "op_amount", "payer", "intermediary", "payee", "bilateral", "pmr_cents", "nodes").agg(F.sort_array(F.collect_list(F.struct("leg", "edge_id", "fs"))).alias("legs"))
    path, at = F.col("kind") == "path", lambda k, f: F.when(F.col("kind") == "path", F.get("legs", F.lit(k))[f])
    return ops.select(
        "component", "op_seq", "kind", "day_index", F.col("op_amount").alias("amount_cents"), "payer", "intermediary", "payee", at(0, "edge_id").alias("in_edge"), at(1, "edge_id").alias("out_edge"), "bilateral", "pmr_cents", "nodes",
        F.when(~path, F.transform("legs", lambda x: x["edge_id"])).alias("edges"), at(0, "fs").alias("in_fragments"), at(1, "fs").alias("out_fragments"),
        F.when(~path, F.transform("legs", lambda x: F.struct(x["edge_id"].alias("edge_id"), x["fs"].alias("fragments")))).alias("edge_fragments"),
    )


def flat(ops: DataFrame) -> DataFrame:
    """Nested operations (with component and op_seq) as the fragment table."""
    own = F.when(F.col("kind") == "cycle", F.transform("edge_fragments", lambda e: F.struct(e["edge_id"].alias("edge_id"), e["fragments"].alias("fs"))))
    own = own.otherwise(F.array(F.struct(F.col("in_edge").alias("edge_id"), F.col("in_fragments").alias("fs")), F.struct(F.col("out_edge").alias("edge_id"), F.col("out_fragments").alias("fs"))))
    legs = ops.withColumn("own", own).select("*", F.posexplode("own").alias("leg", "x"))
    pmr = F.coalesce("pmr_cents", F.when(F.col("kind") == "cycle", F.size("edges") * F.col("amount_cents")).when(F.col("bilateral"), 2 * F.col("amount_cents")).otherwise(F.col("amount_cents")))
    out = legs.withColumn("pmr", pmr).select("*", F.posexplode("x.fs").alias("frag_seq", "f"))
    out = out.select(
        F.lit("").alias("run_id"), "component", "op_seq", "kind", "day_index", F.col("amount_cents").alias("op_amount"), "payer", "intermediary", "payee", "bilateral", F.col("pmr").alias("pmr_cents"), "nodes", "leg",
        F.col("x.edge_id").alias("edge_id"), "f.uid", F.col("f.amount_cents").alias("amount_cents"), "f.issue_index", "f.due_index", "f.issue_ordinal", "f.due_ordinal", "frag_seq",
    )
    return out.to(out.sparkSession.createDataFrame([], FRAGMENTS).schema)


NUMBERED = f"component bigint, op_seq bigint, {OPERATIONS}"
#: What a run object says of its masses.
REPORTED = ("pmr_cents", "instruction_mass_cents", "residual_mass_cents")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Operations from JSON lines or from a run object, gzipped or not."""
    return read_run(spark, path)[0]


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int] | None]:
    """Operations of a log, and what it reports of its masses if it is a run object (one JSON value with ``operation_log``).

    JSON lines are read in parallel and report nothing; a run object is one value, which one task reads. An object without
    ``operation_log`` has no operations; one without its masses is refused.
    """
    schema = T.StructType([T.StructField("operation_log", T.ArrayType(T.StructType.fromDDL(NUMBERED))), *(T.StructField(c, T.LongType()) for c in REPORTED)])
    whole = spark.read.schema(schema).option("multiLine", True).json(path)  # of JSON lines this reads the first of each file
    told = whole.filter("operation_log is not null or instruction_mass_cents is not null").select(*REPORTED).first()
    if told is None:
        ops, reported = spark.read.schema(NUMBERED).json(path), None
        place = F.monotonically_increasing_id()
    else:
        reported = told.asDict()
        if lost := [c for c in REPORTED if reported[c] is None]:
            raise RecordError(f"a run object needs {lost}")
        ops = whole.select(F.posexplode("operation_log").alias("_at", "_op")).select("_op.*", "_at")
        place = F.col("_at").cast("bigint")
    if not ops.filter("kind is null or day_index is null or amount_cents is null").isEmpty():
        raise RecordError("operations need kind, day_index and amount_cents")
    # a log without our numbering counts its operations
    return ops.withColumns({"component": F.coalesce("component", F.lit(0).cast("bigint")), "op_seq": F.coalesce("op_seq", place)}).drop("_at"), reported


def write_cycles(cycles: DataFrame, path: str, topology: str, bound: int) -> None:
    """A cycle cache bound to the graph's hash and the length bound."""
    cycles.select("nodes", "edges", F.lit(topology).alias("topology_sha256"), F.lit(bound).alias("length_bound")).write.mode("overwrite").parquet(path)


def read_cycles(spark: SparkSession, path: str, topology: str, bound: int) -> DataFrame:
    """Cycles of a cache, a table of ours or one JSON object (``.json``, ``.json.gz``); raises RecordError if it is of another graph or bound."""
    if path.endswith((".json", ".json.gz")):
        schema = "length_bound int, topology_sha256 string, cycles array<struct<nodes:array<int>,edges:array<int>>>"
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
        cycles = rows.select(F.explode("cycles").alias("c")).select("c.nodes", "c.edges")
    else:
        rows = spark.read.parquet(path)
        cycles = rows.select("nodes", "edges")
    same = (F.col("topology_sha256") == topology) & (F.col("length_bound") == bound)
    if not rows.filter(~F.coalesce(same, F.lit(False))).isEmpty():
        raise RecordError("the cycle cache is of another graph or bound")
    return cycles


#: Pairs of columns that curves come with, and how many halves of cents a unit is.
CURVE_COLUMNS = (("cycle_pmr_cents", "path_pmr_cents", 2), ("cycle_cohort_pmr_cents", "path_cohort_pmr_cents", 2), ("cycle_2023_symmetric_eur", "path_2023_symmetric_eur", 200), ("cycle_total_cents", "path_total_cents", 2))


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """(date, cycle, path) in halves of cents of a curve file with any of the known pairs of columns."""
    raw = read_text_csv(spark, path)
    for cycle, way, unit in CURVE_COLUMNS:
        if cycle in raw.columns and way in raw.columns:
            read = (lambda c: S.half_cents(F.col(c))) if unit == 2 else (lambda c, unit=unit: F.rint(F.col(c).cast("double") * unit).cast("bigint"))
            return raw.select(S.iso_date(F.col("date")).alias("date"), read(cycle).alias("cycle"), read(way).alias("path"))
    raise RecordError(f"no known pair of curve columns among {raw.columns}")


def read_annual(spark: SparkSession, path: str) -> DataFrame:
    raw = read_text_csv(spark, path)
    if lost := missing_columns(raw, ["year"]):
        raise RecordError(f"missing columns: {lost}")
    return raw.withColumn("year", F.col("year").cast("int"))


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def demand_digests(spark: SparkSession, wanted: dict[str, str]) -> None:
    """Raises RecordError unless every file, by its whole path, has its digest."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    whole = lambda p: path(p).getFileSystem(conf).makeQualified(path(p)).toString()
    have = {whole(r["path"]): r["sha256"] for r in file_digests(spark, list(wanted)).collect()}
    if bad := sorted(p for p, d in wanted.items() if have.get(whole(p)) != d):
        raise RecordError(f"files with other contents than pinned: {bad}")
