"""Temporal state as tables: firms, edges, clipped residuals, edge-by-day capacities, and consumption by earliest due date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duewise.functions import scalars as S
from duewise.storage import numbered, small, written


@dataclass
class State:
    """What a phase starts from. ``residuals``: edge_id, u, v, uid, residual, clipped indexes and unclipped ordinals."""

    nodes: DataFrame
    edges: DataFrame
    residuals: DataFrame
    start: str
    horizon: int


def _date(d) -> Column:
    return F.lit(str(d)).cast("date")


def horizon_days(start, end) -> int:
    import datetime as dt

    n = (dt.date.fromisoformat(str(end)) - dt.date.fromisoformat(str(start))).days + 1
    if n <= 0:
        raise ValueError("the horizon ends before it starts")
    return n


def overlapping(records: DataFrame, start, end) -> DataFrame:
    """Records active on some day of the horizon."""
    return records.filter((F.col("due_date") >= _date(start)) & (F.col("issue_date") <= _date(end)))


def clipped(records: DataFrame, start, end) -> DataFrame:
    """Overlapping records with day indexes inside the horizon and ordinals as they are."""
    h = horizon_days(start, end)
    return overlapping(records, start, end).withColumns(
        {
            "issue_index": F.greatest(F.lit(0), S.day_index(F.col("issue_date"), _date(start))).cast("int"), "due_index": F.least(F.lit(h - 1), S.day_index(F.col("due_date"), _date(start))).cast("int"),
            "issue_ordinal": S.ordinal(F.col("issue_date")), "due_ordinal": S.ordinal(F.col("due_date")),
        }
    )


def firms(records: DataFrame) -> DataFrame:
    """(label, node_id) of all parties, also of records outside the horizon, in firm order."""
    labels = records.select(F.col("debtor").alias("label")).union(records.select("creditor")).distinct()
    return numbered(labels, S.node_key(F.col("label")), "node_id")


def build_state(records: DataFrame, start, end) -> State:
    """State of ``records`` between two days, both included; raises ValueError if none is active."""
    nodes = written(firms(records))
    n = nodes.count()
    rows = clipped(records.select("debtor", "creditor", "uid", "amount_cents", "issue_date", "due_date"), start, end).drop("issue_date", "due_date")
    side = lambda name, key: small(nodes.select(F.col("label").alias(name), F.col("node_id").alias(key)), n)
    rows = written(rows.join(side("debtor", "u"), "debtor").join(side("creditor", "v"), "creditor").drop("debtor", "creditor"))
    if rows.isEmpty():
        raise ValueError("no record is active in the horizon")
    edges = written(numbered(rows.groupBy("u", "v").agg(F.sum("amount_cents").alias("mass_cents"), F.count(F.lit(1)).alias("records")), [F.col("u"), F.col("v")], "edge_id"))
    residuals = rows.join(small(edges.select("u", "v", "edge_id")), ["u", "v"]).withColumnRenamed("amount_cents", "residual")
    return State(nodes, edges, written(residuals), str(start), horizon_days(start, end))


def active(residuals: DataFrame, day) -> DataFrame:
    return residuals.filter(F.lit(day).between(F.col("issue_index"), F.col("due_index")))


def capacity_events(residuals: DataFrame) -> DataFrame:
    """(edge_id, day_from, day_to, capacity): stretches of days of one positive capacity, from running sums of changes."""
    change = residuals.select("edge_id", F.explode(F.array(F.struct(F.col("issue_index").alias("day"), F.col("residual").alias("d")), F.struct((F.col("due_index") + 1).alias("day"), (-F.col("residual")).alias("d")))).alias("x"))
    change = change.groupBy("edge_id", F.col("x.day").alias("day")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("edge_id").orderBy("day")
    out = change.withColumn("capacity", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("day").over(w))
    return out.filter("capacity > 0").select("edge_id", F.col("day").alias("day_from"), (F.col("next") - 1).alias("day_to"), "capacity")


def capacity_by_day(residuals: DataFrame) -> DataFrame:
    """(edge_id, day_index, capacity) of all days with capacity."""
    return capacity_events(residuals).select("edge_id", F.explode(F.sequence("day_from", "day_to")).alias("day_index"), "capacity")


def capacity_on(residuals: DataFrame, day) -> DataFrame:
    """(edge_id, u, v, capacity) of the edges active on one day."""
    return active(residuals, day).groupBy("edge_id", "u", "v").agg(F.sum("residual").alias("capacity"))


def common_day(members: DataFrame, residuals: DataFrame, key: list[str]) -> DataFrame:
    """For sets of edges (``key``, edge_id): the largest amount all can carry on one day, and the earliest such day.

    Only days on which some edge's capacity changes need a look, as amounts are constant in between.
    """
    size = members.groupBy(*key).agg(F.countDistinct("edge_id").alias("need"))
    events = capacity_events(residuals)
    spans = members.select(*key, "edge_id").distinct().join(events, "edge_id")
    days = spans.select(*key, F.col("day_from").alias("day_index")).distinct()
    on = spans.join(days, key).filter(F.col("day_index").between(F.col("day_from"), F.col("day_to")))
    amount = on.groupBy(*key, "day_index").agg(F.min("capacity").alias("amount"), F.count(F.lit(1)).alias("have")).join(size, key).filter("have = need")
    best = amount.groupBy(*key).agg(F.max(F.struct("amount", (-F.col("day_index")).alias("back"))).alias("_best"))
    return best.select(*key, F.col("_best.amount").alias("amount_cents"), (-F.col("_best.back")).alias("day_index"))


def consume(residuals: DataFrame, wanted: DataFrame) -> DataFrame:
    """Fragments that pay ``wanted`` (op_id, edge_id, day_index, amount) from records active that day: earliest due, issue, uid first.

    Each edge is asked once; raises nothing itself: a short edge shows as fragments that sum to less.
    """
    rows = residuals.join(wanted, "edge_id").filter(F.col("day_index").between(F.col("issue_index"), F.col("due_index")))
    order = Window.partitionBy("op_id", "edge_id").orderBy("due_ordinal", "issue_ordinal", "uid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("residual").over(order), F.lit(0)))
    rows = rows.withColumn("taken", F.greatest(F.lit(0), F.least("residual", F.col("amount") - F.col("before"))))
    return rows.filter("taken > 0").select("op_id", "edge_id", "day_index", "uid", F.col("taken").cast("bigint").alias("amount_cents"), "before", "issue_index", "due_index", "issue_ordinal", "due_ordinal")


def pair_legs(incoming: DataFrame, outgoing: DataFrame) -> DataFrame:
    """(op_id, in_uid, out_uid, paired, acceleration): both legs of an operation laid end to end and cut where either one changes."""
    left = incoming.select("op_id", F.col("uid").alias("in_uid"), F.col("before").alias("l0"), (F.col("before") + F.col("amount_cents")).alias("l1"), F.col("due_ordinal").alias("due_in"))
    right = outgoing.select("op_id", F.col("uid").alias("out_uid"), F.col("before").alias("r0"), (F.col("before") + F.col("amount_cents")).alias("r1"), F.col("due_ordinal").alias("due_out"))
    met = left.join(right, "op_id").filter((F.col("l0") < F.col("r1")) & (F.col("r0") < F.col("l1")))
    return met.select("op_id", "in_uid", "out_uid", (F.least("l1", "r1") - F.greatest("l0", "r0")).alias("paired"), F.greatest(F.lit(0), F.col("due_in") - F.col("due_out")).alias("acceleration"))


def positions(records: DataFrame) -> DataFrame:
    """(label, net_cents) of each firm: what it is owed less what it owes."""
    legs = records.select(F.col("creditor").alias("label"), F.col("amount_cents").alias("x")).union(records.select("debtor", -F.col("amount_cents")))
    return legs.groupBy("label").agg(F.sum("x").alias("net_cents"))
