"""Writers: records, logs, reports, curves, annual tables, plot-ready tables."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.functions import scalars as S
from duewise.schema import COLUMNS
from duewise.sources.logs import nested


def write_atomic_csv(records: DataFrame, path: str, *, gzip: bool = False, one_file: bool = False) -> None:
    """Canonical columns in their order; ``one_file`` only for small outputs."""
    out = records.select(*COLUMNS)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, escape='"', dateFormat="yyyy-MM-dd", emptyValue="", **({"compression": "gzip"} if gzip else {}))


def write_log(fragments: DataFrame, path: str, *, gzip: bool = True) -> None:
    """Operations as JSON lines."""
    nested(fragments).write.mode("overwrite").json(path, **({"compression": "gzip"} if gzip else {}))


def plain(value):
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items() if not isinstance(v, DataFrame)}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def report_json(report: dict) -> str:
    """A small report, keys sorted."""
    return json.dumps(plain(report), indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_text(spark, text: str, path: str) -> None:
    """A small text file wherever Spark can write."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def curve_table(curves: DataFrame, start, *, names: tuple[str, str, str] = ("cycle_pmr_cents", "path_pmr_cents", "path_advantage_cents"), halves: bool = False, issue_days: int | None = None) -> DataFrame:
    """Curves by date as they are written: whole cents, or halves as fractions; ``issue_days`` adds the phase."""
    text = S.half_cents_text if halves else (lambda c: c.cast("string"))
    out = curves.select("day_index", F.date_add(F.lit(str(start)).cast("date"), F.col("day_index")).alias("date"), *[text(F.col(c)).alias(n) for c, n in zip(("cycle", "path", "advantage"), names, strict=True)])
    return out if issue_days is None else out.withColumn("phase", F.when(F.col("day_index") < issue_days, "issue-year").otherwise("bridge"))


def write_curve(table: DataFrame, path: str) -> None:
    table.orderBy("date").drop("day_index").coalesce(1).write.mode("overwrite").csv(path, header=True)  # one row a day


def annual_results(cycle: DataFrame, path: DataFrame) -> DataFrame:
    """Both methods' cohorts by year with shares and advantages; issue masses must agree."""
    left, right = (df.select("year", *[F.col(c).alias(f"{m}_{c}") for c in df.columns if c not in ("year", "method")]) for m, df in (("cycle", cycle), ("path", path)))
    out = left.join(right, "year").withColumn("issue_mass_bn", F.when(F.col("cycle_issue_mass_cents") == F.col("path_issue_mass_cents"), F.col("cycle_issue_mass_cents") / 1e11).otherwise(F.raise_error(F.lit("issue masses differ")).cast("double")))
    for m in ("cycle", "path"):
        out = out.withColumn(f"{m}_terminal_pct", S.percent(F.col(f"{m}_terminal_symmetric_half_cents"), F.col(f"{m}_issue_mass_cents")))
    return out.withColumn("terminal_advantage_pp", F.col("path_terminal_pct") - F.col("cycle_terminal_pct"))


def boundary_audit(results: DataFrame) -> DataFrame:
    """The carry figures of an annual table; nothing is ever reused, so the flag is false."""
    kept = [c for c in results.columns if "bridge_" in c]
    return results.select("year", *kept).withColumn("records_reused", F.lit(False))


def aggregate_summary(results: DataFrame) -> DataFrame:
    """One row over all cohorts, and over those with a whole bridge: masses, PMR, shares, wins."""
    whole = F.col("cycle_bridge_complete_jan_feb")

    def part(prefix: str, of):
        s = lambda c: F.sum(F.when(of, F.col(c)))
        mass = s("cycle_issue_mass_cents")
        share = lambda m: S.percent(s(f"{m}_terminal_symmetric_half_cents"), mass)
        return [mass.alias(f"{prefix}issue_mass_cents"), *[s(f"{m}_terminal_symmetric_half_cents").alias(f"{prefix}{m}_half_cents") for m in ("cycle", "path")], *[share(m).alias(f"{prefix}{m}_pct") for m in ("cycle", "path")], (share("path") - share("cycle")).alias(f"{prefix}advantage_pp")]

    ahead = F.col("path_terminal_symmetric_half_cents") - F.col("cycle_terminal_symmetric_half_cents")
    return results.agg(*part("", F.lit(True)), *part("complete_", whole), F.count_if(ahead > 0).alias("path_wins"), F.count_if(ahead < 0).alias("cycle_wins"), F.count_if(ahead == 0).alias("ties"))


def plot_tables(results: DataFrame) -> dict[str, DataFrame]:
    """What figures show: shares and advantage by year, masses, cyclic saturation."""
    return {
        "annual_pmr": results.select("year", "cycle_terminal_pct", "path_terminal_pct"), "advantage": results.select("year", "terminal_advantage_pp"), "mass": results.select("year", "issue_mass_bn"),
        "saturation": results.select("year", F.col("cycle_main_initially_feasible_cycles").alias("feasible_cycles"), F.col("cycle_main_cycle_inventory").alias("cycles")),
    }


def percent_curve(curves: DataFrame, mass: int) -> DataFrame:
    return curves.select("day_index", *[(F.col(c) / mass * 100).alias(f"{c}_pct") for c in ("cycle", "path")])
