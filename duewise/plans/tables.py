"""Records made of orders and their lines, and the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duewise.functions import scalars as S
from duewise.operators import attribution as att
from duewise.operators import graph
from duewise.operators import state as st
from duewise.operators.clearing import operations, run_policy
from duewise.operators.components import strong_components, weak_components
from duewise.operators.replay import ledger, replay, residual_records
from duewise.plans import bound as lp
from duewise.plans import phases
from duewise.sources.atomic import duplicate_audit, keep_first, load_audit
from duewise.storage import small
from duewise.streaming.arrivals import daily_arrivals

YEAR = ("1998-01-01", "1998-12-31")
BOUND = 3  # edges of a cycle: the tables' graph is nearly complete, so longer cycles are more than any machine lists
DAY = "1998-03-16"
STEP = 100_000  # an edge's id is u * STEP + v, in 64 bits: 32 hold the ids of 21,474 firms only


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as obligations between as many firms as there are suppliers, each with the first rule it breaks."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    n = read("supplier").agg(F.count(F.lit(1)).alias("n"))
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = lines.join(read("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    # numbered after the join, by its partitions: one shuffle of lines; the date is among the keys so that periods are cut before
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber", "o_orderdate").orderBy(*order))).crossJoin(F.broadcast(n))  # n is one row
    rows = rows.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "rn").alias("uid"), F.concat(F.lit("company:"), F.col("o_custkey") % F.col("n")).alias("debtor"), F.concat(F.lit("company:"), F.col("l_suppkey") % F.col("n")).alias("creditor"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_cents"), F.to_date("o_orderdate").alias("issue_date"), F.to_date("l_shipdate").alias("due_date"), F.lit("").alias("status"), F.lit("").alias("source"),
    )
    rows = rows.withColumns({"fingerprint": S.fingerprint(*[F.col(c) for c in ("debtor", "creditor", "issue_date", "due_date", "amount_cents")]), "cohort": F.year("issue_date").cast("string")})
    reason = (
        F.when(F.col("amount_cents").isNull() | (F.col("amount_cents") <= 0), "bad amount").when(F.col("due_date").isNull(), "bad due").when(F.col("due_date") < F.col("issue_date"), "negative maturity")
        .when(F.col("debtor") == F.col("creditor"), "self")
    )
    return rows.withColumn("reject_reason", reason)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_invoices(spark, sf_dir).filter("reject_reason is null").drop("reject_reason")


def _pairs(records: DataFrame) -> DataFrame:
    return records.select(F.col("debtor").alias("u"), F.col("creditor").alias("v")).distinct()


def _number(label: str):
    return F.substring_index(label, ":", -1).cast("bigint")


def _edge_id(u, v):
    return F.col(u).cast("bigint") * STEP + F.col(v)


def _ids_as_in_sql(df: DataFrame, spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Edge ids in SQL's type, INTEGER, as long as those of all firms fit; BIGINT beyond."""
    firms = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    return df.withColumns({c: F.col(c).cast("int") for c in names}) if firms * (STEP + 1) < 2**31 else df


def _edges(records: DataFrame) -> DataFrame:
    """Edges whose ids and firms are the firms' own numbers, so that SQL has the same ones."""
    return records.select(_number("debtor").cast("int").alias("u"), _number("creditor").cast("int").alias("v")).distinct().withColumn("edge_id", _edge_id("u", "v"))


def _residuals(records: DataFrame, span: tuple[str, str]) -> DataFrame:
    rows = st.clipped(records, *span).withColumns({"u": _number("debtor").cast("int"), "v": _number("creditor").cast("int")})
    return rows.withColumn("edge_id", _edge_id("u", "v")).withColumnRenamed("amount_cents", "residual")


def invoice_scan_by_year(spark, d):
    return invoices(spark, d).groupBy(F.year("issue_date").alias("issue_year")).agg(F.count(F.lit(1)).alias("n_records"), F.sum("amount_cents").alias("mass_cents"), F.min("due_date").alias("first_due"), F.max("due_date").alias("last_due"))


def reject_audit(spark, d):
    return load_audit(raw_invoices(spark, d))


def duplicates(spark, d):
    return duplicate_audit(raw_invoices(spark, d))


def keep_first_dedup(spark, d):
    return keep_first(invoices(spark, d), "fingerprint", ["uid"]).groupBy("cohort").agg(F.count(F.lit(1)).alias("n_records"), F.sum("amount_cents").alias("mass_cents"), F.min("uid").alias("first_uid"))


def horizon_clip(spark, d):
    return st.clipped(invoices(spark, d), *YEAR).select("uid", "issue_index", "due_index", "issue_ordinal", "due_ordinal")


def cohort_mass(spark, d):
    return invoices(spark, d).groupBy("cohort", "debtor").agg(F.sum("amount_cents").alias("mass_cents"))


def firm_net_position(spark, d):
    return st.positions(invoices(spark, d))


def node_numbers(spark, d):
    return st.firms(invoices(spark, d))


def edge_day_capacity_events(spark, d):
    return _ids_as_in_sql(st.capacity_events(_residuals(invoices(spark, d), YEAR)), spark, d, "edge_id")


def edge_day_capacity(spark, d):
    by_day = st.capacity_by_day(_residuals(invoices(spark, d), YEAR))
    return by_day.groupBy("day_index").agg(F.sum("capacity").alias("capacity"), F.count(F.lit(1)).alias("edges"), F.max("capacity").alias("largest"))


def two_paths(spark, d):
    return graph.two_path_counts(_edges(invoices(spark, d)))


def reciprocal_pairs(spark, d):
    return _ids_as_in_sql(graph.reciprocal_pairs(_edges(invoices(spark, d))), spark, d, "forward_edge", "back_edge")


def pair_common_day_capacity(spark, d):
    records = invoices(spark, d)
    pairs = graph.reciprocal_pairs(_edges(records)).select("a", "b", F.explode(F.array("forward_edge", "back_edge")).alias("edge_id"))
    return st.common_day(pairs, _residuals(records, YEAR), ["a", "b"])


def _named(found: DataFrame) -> DataFrame:
    return found.withColumn("cycle", F.array_join("nodes", ">"))


def cycles_bounded(spark, d):
    return _named(graph.cycles(_edges(invoices(spark, d)), BOUND)).groupBy(F.size("nodes").alias("length"), F.element_at("nodes", 1).alias("first_node")).agg(F.count(F.lit(1)).alias("cycles"), F.min("cycle").alias("least"), F.max("cycle").alias("greatest"))


def cycle_inventory(spark, d):
    return graph.inventory(graph.cycles(_edges(invoices(spark, d)), BOUND))


def _cycles_with_days(spark, d) -> tuple[DataFrame, DataFrame]:
    """Cycles whose edges have a day of the year in common, and the residuals; only what either needs is written."""
    residuals = phases.written(_residuals(invoices(spark, d), YEAR).select("edge_id", "u", "v", "residual", "issue_index", "due_index"))
    edges = residuals.select("u", "v", "edge_id").distinct()  # an edge without a record in the year has no day
    found = phases.written(graph.cycles(edges, BOUND, feasible_days=graph.day_sets(residuals)).select("nodes", "edges"))
    return found, residuals


def cycle_common_day_capacity(spark, d):
    found, residuals = _cycles_with_days(spark, d)
    return _named(graph.best_days(found, residuals)).select("cycle", "amount_cents", "day_index")


def feasible_cycle_days(spark, d):
    """By day of the year, how many cycles can clear something, and the sum and largest of what each could alone."""
    return graph.feasible_day_sums(*_cycles_with_days(spark, d))


def topology_degrees(spark, d):
    return graph.degrees(_pairs(invoices(spark, d)))


def _links(records: DataFrame) -> DataFrame:
    return _edges(records).select(F.col("u").cast("bigint").alias("a"), F.col("v").cast("bigint").alias("b"))


def weak_parts(spark, d):
    return weak_components(_links(invoices(spark, d)))


def strong_parts(spark, d):
    return strong_components(_links(invoices(spark, d)))


def topology(spark, d):
    return graph.topology(invoices(spark, d))


def _reciprocal_day(records: DataFrame):
    """Both sides of every reciprocal pair active on DAY, and what they clear."""
    on = st.capacity_on(_residuals(records, YEAR), F.datediff(F.lit(DAY).cast("date"), F.lit(YEAR[0]).cast("date")))
    back = on.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("edge_id").alias("back_edge"), F.col("capacity").alias("back"))
    both = on.filter("u < v").join(back, ["u", "v"])
    return both.select(F.col("u").alias("a"), F.col("v").alias("b"), "edge_id", "back_edge", F.least("capacity", "back").alias("amount_cents"))


def single_day_bilateral_clearing(spark, d):
    return _reciprocal_day(invoices(spark, d)).select("a", "b", "amount_cents", (2 * F.col("amount_cents")).alias("pmr_cents"))


def _day_fragments(records: DataFrame) -> DataFrame:
    ops = _reciprocal_day(records).withColumn("op_id", F.concat_ws("-", "a", "b"))
    wanted = ops.select("op_id", F.explode(F.array("edge_id", "back_edge")).alias("edge_id"), F.col("amount_cents").alias("amount"), F.datediff(F.lit(DAY).cast("date"), F.lit(YEAR[0]).cast("date")).alias("day_index"))
    return st.consume(_residuals(records, YEAR), wanted)


def waterfall_consumption(spark, d):
    return _ids_as_in_sql(_day_fragments(invoices(spark, d)).select("op_id", "edge_id", "uid", "amount_cents", "before"), spark, d, "edge_id")


def fifo_leg_pairing(spark, d):
    f = _day_fragments(invoices(spark, d)).withColumn("forward", F.floor(F.col("edge_id") / STEP) < F.col("edge_id") % STEP)
    return st.pair_legs(f.filter("forward"), f.filter("not forward")).withColumn("acceleration", F.col("acceleration").cast("bigint"))


def residuals_after_day(spark, d):
    records = invoices(spark, d)
    return residual_records(records, _day_fragments(records)).groupBy("cohort").agg(F.count(F.lit(1)).alias("n_records"), F.sum("amount_cents").alias("mass_cents"))


def cohort_attribution_rules(spark, d):
    """The day's clearing split by whether a fragment was issued in 1998: bilateral operations count both legs."""
    records = invoices(spark, d)
    f = _day_fragments(records).withColumns({"component": F.lit(0).cast("bigint"), "op_seq": F.col("op_id"), "kind": F.lit("path"), "bilateral": F.lit(True), "leg": F.when(F.floor(F.col("edge_id") / STEP) < F.col("edge_id") % STEP, 0).otherwise(1)})
    f = f.withColumn("op_amount", F.sum("amount_cents").over(Window.partitionBy("op_id", "leg")))
    return att.operation_shares(f, att.cohort_of(records, "1998")).select(F.col("op_seq").alias("op_id"), "symmetric", "conservative", "liberal")


def consumption_ledger(spark, d):
    records = invoices(spark, d)
    return ledger(records.select("uid", "amount_cents"), _day_fragments(records).select("uid", "amount_cents"))


def best_path_per_intermediary(spark, d):
    """The leading non-bilateral or the best reciprocal path at each firm on DAY, by the policies' key."""
    on = st.capacity_on(_residuals(invoices(spark, d), YEAR), F.datediff(F.lit(DAY).cast("date"), F.lit(YEAR[0]).cast("date")))
    rank = lambda key, end: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("capacity"), end))
    ins = on.select(F.col("v").alias("firm"), F.col("u").alias("payer"), "capacity").withColumn("k", rank("firm", "payer")).filter("k <= 2")
    outs = on.select(F.col("u").alias("firm"), F.col("v").alias("payee"), "capacity").withColumn("j", rank("firm", "payee")).filter("j <= 2")
    lead = ins.join(outs.withColumnRenamed("capacity", "out"), "firm")
    same = F.max(F.when((F.col("k") == 1) & (F.col("j") == 1), (F.col("payer") == F.col("payee")).cast("int"))).over(Window.partitionBy("firm"))
    lead = lead.withColumn("same", same).filter(F.when(F.col("same") == 1, F.col("k") + F.col("j") == 3).otherwise(F.col("k") + F.col("j") == 2))
    lead = lead.select("firm", F.least("capacity", "out").alias("q"), F.lit(1).alias("rank"), "payer", "payee")
    back = on.select(F.col("v").alias("firm"), F.col("u").alias("payer"), "capacity").join(on.select(F.col("u").alias("firm"), F.col("v").alias("payer"), F.col("capacity").alias("out")), ["firm", "payer"])
    back = back.select("firm", F.least("capacity", "out").alias("q"), F.lit(0).alias("rank"), "payer", F.col("payer").alias("payee"))
    both = lead.union(back).withColumn("key", F.struct((-F.col("q") * (2 - F.col("rank"))).alias("score"), (-F.col("q")).alias("q"), "rank", "payer", "payee"))
    best = both.groupBy("firm").agg(F.min("key").alias("k"))
    return best.select("firm", "k.payer", "k.payee", (-F.col("k.q")).alias("amount_cents"), (-F.col("k.score")).alias("pmr_cents"))


def fragment_pair_attribution(spark, d):
    """Each firm's best path on DAY, taken alone, split pair by pair of fragments by whether they were issued in 1998."""
    records = invoices(spark, d)
    day = F.datediff(F.lit(DAY).cast("date"), F.lit(YEAR[0]).cast("date"))
    paths = best_path_per_intermediary(spark, d).select(F.col("firm").alias("op_id"), "amount_cents", (F.col("payer") == F.col("payee")).alias("bilateral"), F.explode(F.array(F.struct(F.lit(0).alias("leg"), F.col("payer").alias("u"), F.col("firm").alias("v")), F.struct(F.lit(1).alias("leg"), F.col("firm").alias("u"), F.col("payee").alias("v")))).alias("x"))
    paths = phases.written(paths.select("op_id", "bilateral", F.col("x.leg").alias("leg"), _edge_id("x.u", "x.v").alias("edge_id"), F.col("amount_cents").alias("amount"), day.alias("day_index")))
    taken = st.consume(_residuals(records, YEAR), paths.select("op_id", "edge_id", "amount", "day_index")).join(paths.select("op_id", "edge_id", "leg", "bilateral"), ["op_id", "edge_id"])
    taken = taken.withColumns({"component": F.lit(0).cast("bigint"), "op_seq": F.col("op_id"), "kind": F.lit("path"), "frag_seq": F.col("before")})
    return att.paired_shares(taken, att.cohort_of(records, "1998")).select(F.col("op_seq").alias("firm"), *att.RULES)


def representative_days(spark, d):
    return lp.representative_days(_residuals(invoices(spark, d), YEAR), 365)


def _model_size(records: DataFrame, span: tuple[str, str], days: int) -> DataFrame:
    pairs = graph.reciprocal_pairs(_edges(records))
    moves = pairs.select(F.concat_ws("-", "a", "b").alias("label"), F.lit(2).alias("pmr_per_unit"), F.array("forward_edge", "back_edge").alias("edges"))
    return lp.model_counts(st.State(records, records, phases.written(_residuals(records, span)), span[0], days), moves)


def lp_model_size(spark, d):
    """Size of the bilateral model of all records, from the first issue to the last due date."""
    records = invoices(spark, d)
    first, last = records.agg(F.min("issue_date"), F.max("due_date")).first()
    span = (str(first), str(last)) if first else YEAR
    return _model_size(records, span, (last - first).days + 1 if first else 365)


def event_days(spark, d):
    out = daily_arrivals(spark.read.parquet(f"{d}/events.parquet"))
    return out.select("day", "arrivals", F.round("total", 2).alias("total"))


# --- policies: no SQL expresses their fixed points; tests compare them with small references, and each row carries its replay ---


def _policy(name: str):
    def query(spark, d):
        records = invoices(spark, d)
        state = st.build_state(records, *YEAR)
        loops = phases.feasible_cycles(state, BOUND)[0] if name.startswith(("cycle", "mixed")) else None
        fragments = phases.written(run_policy(state, name, cycles=loops))
        one = replay(state, fragments).drop("operations", "instruction_mass_cents")
        return att.summary(fragments).crossJoin(one).withColumn("policy", F.lit(name))  # one row each

    return query


def path_curve(spark, d):
    state = st.build_state(invoices(spark, d), *YEAR)
    return att.dated(att.pmr_curve(run_policy(state, "path_daily_local"), state.horizon), YEAR[0])


def operation_log(spark, d):
    state = st.build_state(invoices(spark, d), *YEAR)
    return operations(run_policy(state, "path_daily_local"))


def _years(spark, d) -> tuple[dict[int, DataFrame], int, int]:
    records = phases.written(invoices(spark, d))
    first, last = records.agg(F.min(F.year("issue_date")), F.max(F.year("issue_date"))).first()
    return {y: records.filter(F.year("issue_date") == y) for y in range(first, last + 1)}, first, last


def rolling_cohorts(spark, d):
    """All cohorts that have a next year to bridge into, path method."""
    import datetime as dt

    years, first, last = _years(spark, d)
    out = phases.rolling_cohorts(years, first, last - 1, dt.date(last, 2, 8), "path")
    return spark.createDataFrame([{k: v for k, v in c.items() if not k.endswith("seconds") and v is not None} for c in out.cohorts])


def two_phase_bridge(spark, d):
    """The records of 1997 over their year, and what is left with those of 1998 to the end of February."""
    years, _, _ = _years(spark, d)
    out = phases.two_phase(years[1997], years[1998], cohort="1997", issue_start="1997-01-01", issue_end="1997-12-31", bridge_start="1998-01-01", execution_end="1998-02-28", bound=BOUND)
    return spark.createDataFrame([{"method": m, "issue_mass_cents": out["issue_mass_cents"], **{k: v for k, v in out[m].items() if isinstance(v, int)}} for m in phases.METHODS])


def lp_upper_bound(spark, d):
    """The exact bound of a four-record instance whose greedy, causal and best schedules differ."""
    import datetime as dt

    day = lambda k: dt.date(2025, 1, k)
    rows = [("ab", "company:A", "company:B", 10, 1, 3), ("bc", "company:B", "company:C", 10, 3, 3), ("bd", "company:B", "company:D", 6, 1, 1), ("eb", "company:E", "company:B", 6, 2, 3)]
    records = spark.createDataFrame([(u, a, b, q, day(i), day(j)) for u, a, b, q, i, j in rows], "uid string, debtor string, creditor string, amount_cents bigint, issue_date date, due_date date")
    state = st.build_state(records, "2025-01-01", "2025-01-03")
    value = lambda p: operations(run_policy(state, p)).agg(F.sum("pmr_cents")).first()[0]
    best = lp.upper_bound(state, moves="path")["upper_bound_cents"]
    return spark.createDataFrame([("greedy", float(value("path_offline"))), ("causal", float(value("path_daily"))), ("bound", best)], "schedule string, pmr_cents double")


QUERIES = {
    "invoice_scan_by_year": invoice_scan_by_year, "reject_audit": reject_audit, "duplicate_audit": duplicates, "keep_first_dedup": keep_first_dedup, "horizon_clip": horizon_clip, "cohort_mass": cohort_mass,
    "firm_net_position": firm_net_position, "node_numbers": node_numbers, "edge_day_capacity_events": edge_day_capacity_events, "edge_day_capacity": edge_day_capacity, "two_paths": two_paths, "reciprocal_pairs": reciprocal_pairs,
    "pair_common_day_capacity": pair_common_day_capacity, "cycles_bounded": cycles_bounded, "cycle_inventory": cycle_inventory, "cycle_common_day_capacity": cycle_common_day_capacity, "feasible_cycle_days": feasible_cycle_days,
    "topology_degrees": topology_degrees, "weak_components": weak_parts, "strong_components": strong_parts, "topology": topology, "single_day_bilateral_clearing": single_day_bilateral_clearing,
    "waterfall_consumption": waterfall_consumption, "fifo_leg_pairing": fifo_leg_pairing, "residuals_after_day": residuals_after_day, "cohort_attribution_rules": cohort_attribution_rules, "consumption_ledger": consumption_ledger,
    "best_path_per_intermediary": best_path_per_intermediary, "representative_days": representative_days, "lp_model_size": lp_model_size, "event_days": event_days, "path_curve": path_curve, "operation_log": operation_log,
    "fragment_pair_attribution": fragment_pair_attribution, "rolling_cohorts": rolling_cohorts, "two_phase_bridge": two_phase_bridge, "lp_upper_bound": lp_upper_bound,
    **{f"policy_{p}": _policy(p) for p in ("path_daily_local", "path_daily", "path_daily_amount", "path_offline_local", "path_offline", "path_offline_amount", "cycle_daily", "cycle_offline", "mixed_cycle_then_path", "mixed_path_then_cycle")},
}
