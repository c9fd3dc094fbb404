"""One run over a file of records, and its commands: run, replay, topology, plot."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.operators import attribution as att
from duewise.operators import graph
from duewise.operators.clearing import run_policy
from duewise.operators.replay import ReplayError, demand_pass, replay
from duewise.operators.state import build_state
from duewise.plans.phases import feasible_cycles
from duewise.sinks import files
from duewise.sources.atomic import RecordError, load_atomic_csv
from duewise.sources.logs import file_digests, flat, read_curve, read_cycles, read_run, write_cycles
from duewise.storage import written

RUNS = {("cycle", "daily"): "cycle_daily", ("path", "daily"): "path_daily", ("cycle", "offline"): "cycle_offline", ("path", "offline"): "path_offline"}


def options(pairs: list[str]) -> dict[str, str]:
    """``KEY=VALUE`` texts as a mapping."""
    out = {}
    for p in pairs:
        key, sign, value = p.partition("=")
        if not sign or not key:
            raise ValueError(f"expected KEY=VALUE, got {p!r}")
        out[key] = value
    return out


def run(spark: SparkSession, records: str, out: str, start: str, end: str, *, methods: tuple[str, ...] = ("cycle", "path"), regimes: tuple[str, ...] = ("daily", "offline"), bound: int = 8, cache: str | None = None, validate: bool = True) -> dict:
    """Each method in each regime over one file: logs, replay reports, daily curves and a summary under ``out``."""
    rows = written(load_atomic_csv(spark, records))
    state = build_state(rows, start, end)
    mass = state.residuals.agg(F.sum("residual")).first()[0]
    chosen = {(m, r): p for (m, r), p in sorted(RUNS.items()) if m in methods and r in regimes}
    if not chosen:
        raise ValueError("no known method and regime chosen")
    loops, topology = None, graph.topology_hash(state)
    if any(m == "cycle" for m, _ in chosen):
        loops = _cycles(spark, state, bound, cache, topology)
    summary: dict = {"input_sha256": file_digests(spark, records).first()["sha256"], "horizon_days": state.horizon, "mass_cents": mass, "topology_sha256": topology, "topology": graph.topology(rows).first().asDict(), "runs": {}}
    curves: dict[str, DataFrame] = {}
    for (method, regime), policy in chosen.items():
        fragments = written(run_policy(state, policy, cycles=loops if method == "cycle" else None))
        name = f"{regime}_{method}"
        files.write_log(fragments, f"{out}/{name}.log.json")
        row = att.summary(fragments).first().asDict()
        if validate:
            checked = demand_pass(replay(state, fragments))
            files.write_text(spark, files.report_json(checked), f"{out}/{name}.validation.json")
            row["residual_mass_cents"] = checked["residual_mass_cents"]
        row["pmr_share_pct"] = row["pmr_cents"] / mass * 100 if mass else None
        if regime == "daily":
            curves[method] = att.pmr_curve(fragments, state.horizon)
            row["auc_cent_days"] = curves[method].agg(F.sum("pmr_cents")).first()[0]
        summary["runs"][name] = row
    if curves:
        zero = next(iter(curves.values())).select("day_index", F.lit(0).cast("bigint").alias("pmr_cents"))
        both = att.compared(curves.get("cycle", zero), curves.get("path", zero), "pmr_cents")
        files.write_curve(files.curve_table(both, start), f"{out}/daily_curves.csv")
    files.write_text(spark, files.report_json(summary), f"{out}/summary.json")
    return summary


def _cycles(spark: SparkSession, state, bound: int, cache: str | None, topology: str) -> DataFrame:
    if cache:
        target = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return read_cycles(spark, cache, topology, bound)
        if cache.endswith((".json", ".json.gz")):
            raise RecordError("caches in JSON are read, not written")
    found = feasible_cycles(state, bound)[0]
    if cache:
        write_cycles(found, cache, topology, bound)
    return found


def replay_logs(spark: SparkSession, records: str, log: str, start: str, end: str) -> dict:
    """Replays a written log over the records, without running a policy."""
    state = build_state(load_atomic_csv(spark, records), start, end)
    ops, reported = read_run(spark, log)
    return demand_pass(replay(state, flat(ops), reported))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="duewise")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "replay", "topology", "plot"):
        p = sub.add_parser(name)
        p.add_argument("--input", "--records", dest="records", required=True)
        if name in ("run", "replay"):
            p.add_argument("--start-date", "--start", dest="start", required=True, type=lambda s: dt.date.fromisoformat(s).isoformat())
            p.add_argument("--end-date", "--end", dest="end", required=True, type=lambda s: dt.date.fromisoformat(s).isoformat())
        if name == "run":
            p.add_argument("--output", "--out", dest="out", required=True)
            p.add_argument("--method", choices=("cycle", "path", "both"), default="both")
            p.add_argument("--regime", choices=("daily", "offline", "both"), default="both")
            p.add_argument("--cycle-bound", "--max-cycle-length", dest="bound", type=int, default=8)
            p.add_argument("--cycle-cache", dest="cache")
            p.add_argument("--no-validate", dest="validate", action="store_false")
        if name == "replay":
            p.add_argument("--log", required=True)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("duewise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    pick = lambda x, all_: all_ if x == "both" else (x,)
    try:
        if a.command == "run":
            print(files.report_json(run(spark, a.records, a.out, a.start, a.end, methods=pick(a.method, ("cycle", "path")), regimes=pick(a.regime, ("daily", "offline")), bound=a.bound, cache=a.cache, validate=a.validate)), end="")
        elif a.command == "replay":
            print(files.report_json(replay_logs(spark, a.records, a.log, a.start, a.end)), end="")
        elif a.command == "topology":
            print(files.report_json(graph.topology(load_atomic_csv(spark, a.records)).first().asDict()), end="")
        else:  # what a figure would show, as a table
            shown = read_curve(spark, a.records).withColumn("advantage", F.col("path") - F.col("cycle"))
            shown.orderBy("date").show(max(1, shown.count()), False)
    except (ValueError, RecordError, ReplayError) as e:
        parser.error(str(e))
    return 0
