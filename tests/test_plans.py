import datetime as dt
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from duewise.operators import attribution as att
from duewise.operators import clearing, graph
from duewise.operators.components import strong_components, weak_components
from duewise.operators.replay import ReplayError, replay
from duewise.operators.state import build_state, capacity_by_day
from duewise.plans import bound, phases, run, tables
from duewise.sinks import files
from duewise.sources import logs
from duewise.streaming import arrivals


def issued(spark, uid, a, b, q, first, last, cohort):
    from duewise.schema import RECORDS

    d = dt.date.fromisoformat
    return spark.createDataFrame([(uid, f"company:{a}", f"company:{b}", q, d(first), d(last), "", "", "", cohort)], RECORDS)


def test_bridge_pair(spark):
    one = issued(spark, "m1", "A", "B", 1000, "2025-12-20", "2026-01-31", "2025")
    two = issued(spark, "b1", "B", "C", 1000, "2026-01-05", "2026-01-31", "")
    out = phases.two_phase(one, two, cohort="2025", issue_start="2025-01-01", issue_end="2025-12-31", bridge_start="2026-01-01", execution_end="2026-01-31")
    path, cycle = out["path"], out["cycle"]
    assert (path["issue"]["operations"], path["bridge"]["operations"], path["bridge"]["pmr_cents"], path["residual_mass_cents"]) == (0, 1, 1000, 0)
    assert (path["terminal_symmetric_half_cents"], path["terminal_conservative_half_cents"], path["terminal_liberal_half_cents"]) == (1000, 0, 2000)
    assert cycle["bridge"]["operations"] == 0 and cycle["residual_mass_cents"] == 2000
    with pytest.raises(ValueError, match="must follow"):
        phases.two_phase(one, two, cohort="2025", issue_start="2025-01-01", issue_end="2025-12-31", bridge_start="2025-12-31", execution_end="2026-01-31")


def test_rolling_cohorts_carry_and_close(spark):
    rng = random.Random(3)
    from duewise.schema import RECORDS

    years = {}
    for y in (2020, 2021, 2022):
        rows = []
        for k in range(60):
            a, b = rng.sample("ABCDE", 2)
            i = dt.date(y, 1, 1) + dt.timedelta(days=rng.randrange(365))
            rows.append((f"main:{y}-{k}", f"company:{a}", f"company:{b}", rng.randint(1, 99), i, i + dt.timedelta(days=rng.randrange(90)), "", "", "", str(y)))
        years[y] = spark.createDataFrame(rows, RECORDS)
    out = phases.rolling_cohorts(years, 2020, 2021, dt.date(2022, 2, 8), "path")
    assert out.audit["all_pass"] and all(p["all_pass"] for p in out.phases) and len(out.cohorts) == 2
    for c in out.cohorts:
        assert c["bridge_new_mass_cents"] == c["bridge_new_consumed_mass_cents"] + c["bridge_residual_carried_mass_cents"]
        curve = [r["symmetric"] for r in out.curves[c["year"]].orderBy("day_index").collect()]
        assert curve == sorted(curve) and curve[-1] == c["terminal_symmetric_half_cents"]
        assert c["terminal_conservative_half_cents"] <= c["terminal_symmetric_half_cents"] <= c["terminal_liberal_half_cents"]
    assert out.cohorts[0]["bridge_complete_jan_feb"] and not out.cohorts[1]["bridge_complete_jan_feb"]
    cyc = phases.rolling_cohorts(years, 2020, 2021, dt.date(2022, 2, 8), "cycle", bound=3)
    rows = lambda r: spark.createDataFrame([{k: v for k, v in c.items() if v is not None} for c in r.cohorts])
    table = files.annual_results(rows(cyc), rows(out))
    assert table.count() == 2 and files.aggregate_summary(table).first()["path_wins"] + files.aggregate_summary(table).first()["cycle_wins"] + files.aggregate_summary(table).first()["ties"] == 2
    assert not files.boundary_audit(table).filter("records_reused").count() and set(files.plot_tables(table)) == {"annual_pmr", "advantage", "mass", "saturation"}
    with pytest.raises(ValueError, match="years missing"):
        phases.rolling_cohorts(years, 2020, 2022, dt.date(2023, 2, 8), "path")


def test_upper_bound(records):
    state = build_state(records([("ab", "A", "B", 10, 1, 3), ("bc", "B", "C", 10, 3, 3), ("bd", "B", "D", 6, 1, 1), ("eb", "E", "B", 6, 2, 3)]), "2025-01-01", "2025-01-03")
    assert bound.upper_bound(state)["upper_bound_cents"] == 16.0
    rng = random.Random(8)
    for _ in range(2):
        rows = [(f"u{k}", *rng.sample("ABC", 2), rng.randint(1, 9), i := rng.randint(1, 3), i + rng.randint(0, 2)) for k in range(6)]
        state = build_state(records(rows), "2025-01-01", "2025-01-04")
        best = bound.upper_bound(state)
        loops = graph.cycles(state.edges, 3)
        assert best["status"] == "optimal"
        for policy in ("path_daily", "cycle_daily", "path_offline"):
            assert att.summary(clearing.run_policy(state, policy, cycles=loops)).first()["pmr_cents"] <= best["upper_bound_cents"] + 1e-9


def test_attribution_by_operation_and_by_pair(spark):
    from duewise.schema import FRAGMENTS

    row = lambda op, leg, k, uid, q, n, bilateral=False: ("", 0, op, "path", 0, n, 0, 1, 2, bilateral, n, None, leg, leg, uid, q, 0, 0, 0, 0, k)
    log = spark.createDataFrame([row(0, 0, 0, "x", 3, 5), row(0, 0, 1, "o", 2, 5), row(0, 1, 0, "y", 1, 5), row(0, 1, 1, "o2", 4, 5), row(1, 0, 0, "x", 2, 2, True), row(1, 1, 0, "o", 2, 2, True)], FRAGMENTS)
    mine = spark.createDataFrame([("x", True), ("y", True), ("o", False)], "uid string, mine boolean")
    a = {r["op_seq"]: (r["symmetric"], r["conservative"], r["liberal"]) for r in att.operation_shares(log, mine).collect()}
    b = {r["op_seq"]: (r["symmetric"], r["conservative"], r["liberal"]) for r in att.paired_shares(log, mine).collect()}
    assert a == {0: (4, 0, 10), 1: (4, 4, 4)} and b == {0: (4, 2, 6), 1: (4, 4, 4)}


def test_components_against_search(spark):
    rng = random.Random(5)
    for n in (6, 14):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(1.4 * n))]
        nodes = {x for e in links for x in e}

        def reach(a, both, links=links):
            seen, todo = {a}, [a]
            while todo:
                x = todo.pop()
                for u, v in links:
                    for s, t in ((u, v), (v, u)) if both else ((u, v),):
                        if s == x and t not in seen:
                            seen.add(t)
                            todo.append(t)
            return seen

        frame = spark.createDataFrame(links, "a bigint, b bigint")
        assert {r["node"]: r["component"] for r in weak_components(frame).collect()} == {a: min(reach(a, True)) for a in nodes}
        assert {r["node"]: r["component"] for r in strong_components(frame).collect()} == {a: min(x for x in reach(a, False) if a in reach(x, False)) for a in nodes}


def test_topology_and_capacities(six):
    row = graph.topology(six).first()
    assert (row["firms"], row["edges"], row["weak_components"], row["strong_components"], row["firms_nontrivial_scc"], row["local_two_edge_paths"], row["cyclic_local_two_edge_paths"]) == (7, 6, 2, 5, 3, 6, 6)
    assert row["directed_density"] == pytest.approx(1 / 7) and row["largest_wcc_share"] == pytest.approx(5 / 7) and row["topological_opportunity_ratio"] == 1.0
    acyclic = graph.topology(six.filter("uid = 'r6'")).first()
    assert acyclic["topological_opportunity_ratio"] == float("inf") or acyclic["local_two_edge_paths"] == 0
    state = build_state(six, "2025-01-01", "2025-01-12")
    days = capacity_by_day(state.residuals).groupBy("edge_id").count().collect()
    assert sorted(r["count"] for r in days) == [3, 3, 5, 6, 7, 10]


def test_queries_over_whole_tables(spark, tmp_path):
    day = dt.date.fromisoformat
    rows = [(0, 1, "1995-05-01", "1995-06-01"), (2, 1, "1995-05-02", "1995-06-01"), (1, 2, "1995-05-03", "1995-05-20"), (1, 2, "1998-06-01", "1998-06-10"), (2, 3, "1998-06-02", "1998-06-12")]
    spark.createDataFrame([(k,) for k in range(4)], "s_suppkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, u, day(i)) for k, (u, _, i, _) in enumerate(rows)], "o_orderkey int, o_custkey int, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, 1, 1, v, 1.0, 10.0, 0.0, 0.0, "N", "O", day(j)) for k, (_, v, _, j) in enumerate(rows)]
    names = "l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    run_query = lambda name: tables.QUERIES[name](spark, str(tmp_path)).collect()
    assert (run_query("topology")[0]["firms"], run_query("topology")[0]["edges"]) == (4, 4)
    assert {r["node"]: r["component"] for r in run_query("weak_components")} == {0: 0, 1: 0, 2: 0, 3: 0}
    assert {r["node"]: r["component"] for r in run_query("strong_components")} == {0: 0, 1: 1, 2: 1, 3: 3}
    assert run_query("lp_model_size")[0]["capacity_rows"] == 2
    assert [(r["length"], r["cycles"]) for r in run_query("cycle_inventory")] == [(2, 1)]
    assert run_query("feasible_cycle_days") == []  # the pair's records meet in 1995 alone
    assert [r["pmr_cents"] for r in run_query("operation_log")] == [1000]
    assert max(r["pmr_cents"] for r in run_query("path_curve")) == 1000
    assert run_query("policy_path_offline")[0]["pmr_cents"] == 1000


def test_run_command_logs_and_cache(spark, six, tmp_path):
    files.write_atomic_csv(six, f"{tmp_path}/in.csv", one_file=True)
    options = {"bound": 8, "cache": f"{tmp_path}/cycles"}
    out = run.run(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out", "2025-01-01", "2025-01-12", **options)
    assert {k: r["pmr_cents"] for k, r in out["runs"].items()} == {"daily_cycle": 15000, "daily_path": 16000, "offline_cycle": 15000, "offline_path": 16000}
    assert run.run(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out2", "2025-01-01", "2025-01-12", **options)["runs"].keys() == out["runs"].keys()
    assert json.loads(open(f"{tmp_path}/out/summary.json").read())["horizon_days"] == 12
    assert run.replay_logs(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out/daily_path.log.json", "2025-01-01", "2025-01-12")["all_pass"]
    assert run.replay_logs(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out/daily_cycle.log.json", "2025-01-01", "2025-01-12")["all_pass"]
    curve = logs.read_curve(spark, f"{tmp_path}/out/daily_curves.csv")
    assert curve.agg(F.max("path")).first()[0] == 32000
    with pytest.raises(ValueError, match="cycle cache"):
        logs.read_cycles(spark, f"{tmp_path}/cycles", "other", 8)
    assert run.options(["a=b=c"]) == {"a": "b=c"}


def test_run_objects_and_json_caches(spark, six, tmp_path):
    files.write_atomic_csv(six, f"{tmp_path}/in.csv", one_file=True)
    days = ("2025-01-01", "2025-01-12")
    run.run(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out", *days, methods=("path",), regimes=("daily",))
    ops = [json.loads(x) for x in logs.read_log(spark, f"{tmp_path}/out/daily_path.log.json").orderBy("component", "op_seq").toJSON().collect()]
    state = build_state(six, *days)
    found = replay(state, logs.flat(logs.read_log(spark, f"{tmp_path}/out/daily_path.log.json"))).first()
    said = {"method": "path", "regime": "daily", "operations": len(ops), **{c: found[c] for c in ("instruction_mass_cents", "residual_mass_cents")}, "pmr_cents": 16000}

    def replayed(indent, packed, **other):
        text = json.dumps(said | {"operation_log": [{k: v for k, v in o.items() if k not in ("component", "op_seq")} for o in ops]} | other, indent=indent)
        path = f"{tmp_path}/object.json" + ".gz" * packed
        (gzip.open if packed else open)(path, "wt").write(text)
        return run.replay_logs(spark, f"{tmp_path}/in.csv", path, *days)

    assert replayed(None, False)["all_pass"] and replayed(2, True)["operations"] == len(ops)
    for wrong in ("pmr_cents", "instruction_mass_cents", "residual_mass_cents"):
        with pytest.raises(ReplayError):
            replayed(None, False, **{wrong: said[wrong] + 1})
    with pytest.raises(ValueError, match="needs"):
        replayed(None, False, residual_mass_cents=None)
    with pytest.raises(ReplayError):
        replayed(None, False, operation_log=[])

    with gzip.open(f"{tmp_path}/cycles.json.gz", "wt") as f:
        json.dump({"length_bound": 8, "topology_sha256": "x", "cycles": [{"nodes": [0, 1], "edges": [4, 2]}]}, f)
    assert [tuple(r) for r in logs.read_cycles(spark, f"{tmp_path}/cycles.json.gz", "x", 8).collect()] == [([0, 1], [4, 2])]
    for topology, bound in (("x", 7), ("y", 8)):
        with pytest.raises(ValueError, match="cycle cache"):
            logs.read_cycles(spark, f"{tmp_path}/cycles.json.gz", topology, bound)


def test_annual_series_and_variants(spark, six):
    rows = phases.annual_series([{"cohort": "2025", "input_csv": "x", "issue_start_date": "2025-01-01", "issue_end_date": "2025-01-12"}], lambda path: six)
    assert {r["policy"]: r["pmr_cents"] for r in rows} == {"cycle_daily": 15000, "path_daily": 16000, "cycle_offline": 15000, "path_offline": 16000}
    assert {r["symmetric_half_cents"] for r in rows if r["policy"] == "path_daily"} == {32000} and rows[0]["mass_cents"] == 38000
    assert len(phases.variants({"full": six}, "2025-01-01", "2025-01-12", ("path_daily_amount",))) == 1


def test_streams_equal_batches(spark, six, tmp_path):
    files_dir = f"{tmp_path}/in"
    six.write.parquet(files_dir)
    stream = arrivals.edge_arrivals(spark.readStream.schema(six.schema).parquet(files_dir), late="0 days")
    arrivals.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    batch = {tuple(r) for r in arrivals.edge_arrivals(six).collect()}
    closed = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last = max(r[0] for r in batch)
    assert closed == {r for r in batch if r[0] < last}


def test_cycles_that_can_clear_by_stretch_and_day(spark):
    day = lambda k: dt.date(2025, 1, k)
    rows = [("a", "company:1", "company:2", 10, 1, 5), ("b", "company:2", "company:1", 4, 2, 8), ("c", "company:2", "company:1", 3, 4, 6), ("d", "company:2", "company:3", 9, 1, 9)]
    records = spark.createDataFrame([(u, a, b, q, day(i), day(j)) for u, a, b, q, i, j in rows], "uid string, debtor string, creditor string, amount_cents bigint, issue_date date, due_date date")
    state = build_state(records, "2025-01-01", "2025-01-09")
    found = graph.cycles(state.edges, 8)
    got = {(r["day_from"], r["day_to"]): r["amount_cents"] for r in graph.feasible_stretches(found, state.residuals).collect()}
    by_day = {r["day_index"]: r["amount_cents"] for r in graph.feasible_cycle_days(found, state.residuals).collect()}
    assert got == {(1, 2): 4, (3, 4): 7} and by_day == {1: 4, 2: 4, 3: 7, 4: 7}


def test_edge_ids_of_many_firms(spark, tmp_path):
    day, n = dt.date.fromisoformat, 60_000
    rows = [(59_999, 2, "1998-01-05"), (2, 59_999, "1998-01-06"), (59_998, 59_999, "1998-02-01"), (2, 59_998, "1998-02-02")]
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, u, day(i)) for k, (u, _, i) in enumerate(rows)], "o_orderkey int, o_custkey int, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, 1, 1, v, 1.0, 10.0 + k, 0.0, 0.0, "N", "O", day("1998-06-30")) for k, (_, v, _) in enumerate(rows)]
    names = "l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    run_query = lambda name: sorted(tuple(r) for r in tables.QUERIES[name](spark, str(tmp_path)).collect())
    assert [e[0] for e in run_query("edge_day_capacity_events")] == sorted(u * 100_000 + v for u, v, _ in rows)
    assert run_query("reciprocal_pairs") == [(2, 59_999, 259_999, 5_999_900_002)] and run_query("single_day_bilateral_clearing") == [(2, 59_999, 1000, 2000)]
    assert [r[:3] for r in run_query("waterfall_consumption")] == [("2-59999", 259_999, "1:1:1"), ("2-59999", 5_999_900_002, "0:1:1")]
    assert len(run_query("edge_day_capacity")) == 365 - 4 - (365 - 181) and run_query("consumption_ledger")[0][2] == 2
    assert run_query("cohort_attribution_rules") == [("2-59999", 4000, 4000, 4000)] and len(run_query("best_path_per_intermediary")) == 3
    assert run_query("cycle_inventory") == [(2, 1), (3, 1)] and run_query("cycles_bounded") == [(2, 2, 1, "2>59999", "2>59999"), (3, 2, 1, "2>59998>59999", "2>59998>59999")]
    assert run_query("cycle_common_day_capacity") == [("2>59998>59999", 1000, 32), ("2>59999", 1000, 5)]
    assert run_query("feasible_cycle_days")[0] == (5, 1, 1000, 1000) and run_query("lp_model_size")[0][3] == 2


def test_cycles_closed_by_two_edges(spark, monkeypatch):
    from functools import reduce

    monkeypatch.setattr(graph, "HELD_EDGES", 5)
    monkeypatch.setattr(graph, "AT_ONCE", 3)
    rng = random.Random(1)
    pairs = sorted({(7 * rng.randrange(8), 7 * rng.randrange(8)) for _ in range(34)})
    ids, days = {e: k + 2**33 for k, e in enumerate(pairs)}, {e: [rng.choice([0, 1, 2, 4, 7]), rng.choice([0, 8, 24])] for e in pairs}
    on = lambda p: [(p[k], p[(k + 1) % len(p)]) for k in range(len(p))]
    edges = spark.createDataFrame([(*e, k) for e, k in ids.items()], "u int, v int, edge_id bigint")
    sets = spark.createDataFrame([(ids[e], d) for e, d in days.items()], "edge_id bigint, days array<bigint>")
    written_ = []
    monkeypatch.setattr(graph, "written", lambda df, f=graph.written: written_.append(out := f(df)) or out)
    for most in (2, 3, 5):
        paths, want = [(u, v) for u, v in pairs if u < v], []
        while paths:
            want += [p for p in paths if (p[-1], p[0]) in ids]
            paths = [(*p, v) for p in paths if len(p) < most for u, v in pairs if u == p[-1] and v > p[0] and v not in p]
        got = sorted((tuple(r["nodes"]), tuple(r["edges"])) for r in graph.cycles(edges, most).collect())
        assert got == sorted((p, tuple(ids[e] for e in on(p))) for p in want)
        can = [p for p in want if any(reduce(int.__and__, [days[e][w] for e in on(p)]) for w in (0, 1))]
        assert sorted(tuple(r["nodes"]) for r in graph.cycles(edges, most, feasible_days=sets).collect()) == sorted(can)
    assert all("nodes" not in x.columns or max(len(r["nodes"]) for r in x.collect()) <= 4 for x in written_)  # open paths of the bound's length aren't made


def test_model_counts_without_variables(records):
    rng = random.Random(4)
    for n in (4, 25):
        rows = [(f"u{k}", *rng.sample("ABC", 2), rng.randint(1, 9), i := rng.randint(1, 12), i + rng.randint(0, 4)) for k in range(n)]
        state = build_state(records(rows), "2025-01-03", "2025-01-12")
        for kind in ("path", "cycle"):
            moves = bound.candidates(state, kind)
            assert bound.model_counts(state, moves).first() == bound.model_size(bound.variables(state, moves)).first()


def test_day_sets_come_from_stretches_without_their_days(spark):
    """Words of stretches equal words of days at the edges of words, and no plan of a day set makes days."""
    rng = random.Random(8)
    rows = [(e, 1, i, j) for e in range(40) for i, j in [sorted((rng.randrange(200), rng.randrange(200))) for _ in range(rng.randrange(1, 4))]]
    rows += [(90, 1, 0, 63), (91, 1, 63, 64), (92, 1, 64, 127), (93, 1, 127, 127), (94, 1, 0, 199)]
    residuals = spark.createDataFrame(rows, "edge_id bigint, residual bigint, issue_index int, due_index int")
    found = graph.day_sets(residuals)
    want = {e: sorted({d for x, _, i, j in rows if x == e for d in range(i, j + 1)}) for e in {r[0] for r in rows}}
    assert {r["edge_id"]: r["d"] for r in found.select("edge_id", graph.S.word_days(F.col("days")).alias("d")).collect()} == want
    assert "sequence(day_from" not in found._jdf.queryExecution().analyzed().toString()
    loops = spark.createDataFrame([([1, 2], [90, 94]), ([1, 2, 3], [91, 92, 94]), ([4, 5], [90, 93])], "nodes array<int>, edges array<bigint>")
    assert {tuple(r["nodes"]): (r["amount_cents"], r["day_index"]) for r in graph.best_days(loops, residuals).collect()} == {(1, 2): (1, 0), (1, 2, 3): (1, 64)}
    sums = {r["day_index"]: (r["cycles"], r["amount_cents"], r["largest"]) for r in graph.feasible_day_sums(loops, residuals).collect()}
    assert sums == {d: (1, 1, 1) for d in range(65)}
