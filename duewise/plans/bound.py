"""Full-information upper bound by linear programming: Spark builds variables and rows, an exact simplex solves small models.

Variables: for each operation, day and record the amount the operation takes of it, and the operation's amount that day. Rows:
on each edge the takings add up to the amount; no record gives more than its face. Days at which nothing begins and nothing
has just ended add no freedom and are left out.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duewise.operators import graph
from duewise.operators.state import State
from duewise.storage import small, written

MAX_VARIABLES = 4_000


def representative_days(residuals: DataFrame, horizon: int) -> DataFrame:
    """(day_index): 0, every issue day, and every day after a due date, inside the horizon."""
    days = residuals.select(F.explode(F.array(F.lit(0), F.col("issue_index"), F.col("due_index") + 1)).alias("day_index"))
    return days.filter(F.col("day_index") < horizon).distinct()


def candidates(state: State, moves: str = "both", bound: int | None = None) -> DataFrame:
    """(label, kind, edges, pmr_per_unit): paths and cycles, each once; ``bound`` None takes cycles of any length."""
    if moves not in ("path", "cycle", "both"):
        raise ValueError(f"unknown move set {moves!r}")
    parts = []
    if moves != "cycle":
        p = graph.two_paths(state.edges)
        pair = F.when(F.col("bilateral"), F.sort_array(F.array("in_edge", "out_edge"))).otherwise(F.array("in_edge", "out_edge"))
        parts.append(p.select(F.concat(F.lit("path:"), F.array_join(pair, "-")).alias("label"), F.lit("path").alias("kind"), pair.alias("edges"), F.when(F.col("bilateral"), 2).otherwise(1).alias("pmr_per_unit")).distinct())
    if moves != "path":
        c = graph.cycles(state.edges, bound or max(2, state.nodes.count()))
        parts.append(c.select(F.concat(F.lit("cycle:"), F.array_join("edges", "-")).alias("label"), F.lit("cycle").alias("kind"), "edges", F.size("edges").alias("pmr_per_unit")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def variables(state: State, moves: DataFrame) -> DataFrame:
    """(label, day_index, pmr_per_unit, edge_id, uid, face) of all records that an operation can use on a day it can take place."""
    days = representative_days(state.residuals, state.horizon)
    legs = moves.select("label", "pmr_per_unit", F.size("edges").alias("need"), F.explode("edges").alias("edge_id"))
    records = state.residuals.select("edge_id", "uid", F.col("residual").alias("face"), "issue_index", "due_index")
    live = records.join(days, F.col("day_index").between(F.col("issue_index"), F.col("due_index"))).select("edge_id", "uid", "face", "day_index")
    met = legs.join(live, "edge_id")
    able = met.groupBy("label", "day_index").agg(F.countDistinct("edge_id").alias("have"), F.max("need").alias("need")).filter("have = need").select("label", "day_index")
    return met.join(able, ["label", "day_index"]).select("label", "day_index", "pmr_per_unit", "edge_id", "uid", "face")


def model_size(rows: DataFrame) -> DataFrame:
    """One row: operation days, takings, balance rows, capacity rows."""
    return rows.agg(F.countDistinct("label", "day_index").alias("operation_days"), F.count(F.lit(1)).alias("allocations"), F.countDistinct("label", "day_index", "edge_id").alias("balance_rows"), F.countDistinct("uid").alias("capacity_rows"))


def model_counts(state: State, moves: DataFrame) -> DataFrame:
    """The row of ``model_size(variables(state, moves))`` without making the variables: counted by stretches of days.

    What changes at a move's records changes on representative days only, so running counts by move, and how many such days
    lie before each change, say on how many days all its edges are live and how many records are then.
    """
    spark = state.residuals.sparkSession
    days = sorted(r["day_index"] for r in representative_days(state.residuals, state.horizon).collect())  # no more than the horizon
    before = spark.createDataFrame([(d, k) for k, d in enumerate([*days, *([] if days and days[-1] == state.horizon else [state.horizon])])], "day int, n bigint")
    legs = moves.select("label", F.size("edges").alias("need"), F.explode("edges").alias("edge_id")).distinct()
    mine = state.residuals.select("edge_id", "uid", "issue_index", "due_index").join(small(legs.select("edge_id").distinct()), "edge_id", "left_semi")
    held = written(legs.join(mine, "edge_id"))
    ends = held.select("label", "need", "edge_id", F.explode(F.array(F.struct(F.col("issue_index").alias("day"), F.lit(1).alias("d")), F.struct((F.col("due_index") + 1).alias("day"), F.lit(-1).alias("d")))).alias("x"))
    ends = ends.groupBy("label", "need", "edge_id", F.col("x.day").alias("day")).agg(F.sum("x.d").alias("d"))
    live = ends.withColumn("c", F.sum("d").over(Window.partitionBy("label", "edge_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    turned = (F.col("c") > 0).cast("int") - ((F.col("c") - F.col("d")) > 0).cast("int")
    by = live.groupBy("label", "need", "day").agg(F.sum("d").alias("d"), F.sum(turned).alias("t")).join(F.broadcast(before), "day")
    w = Window.partitionBy("label").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumns({"records": F.sum("d").over(run), "edges": F.sum("t").over(run), "width": F.lead("n", 1, 0).over(w) - F.col("n")})
    by = by.withColumn("width", F.when(F.col("edges") == F.col("need"), F.col("width")).otherwise(0))
    by = written(by.withColumn("so_far", F.sum("width").over(w.rowsBetween(Window.unboundedPreceding, -1))).select("label", "need", "day", "records", "width", F.coalesce("so_far", F.lit(0)).alias("so_far")))
    at = lambda c: by.select("label", F.col("day").alias(f"{c}_day"), F.col("so_far").alias(c))
    used = held.withColumns({"from_day": F.col("issue_index"), "to_day": F.col("due_index") + 1}).join(at("from"), ["label", "from_day"]).join(at("to"), ["label", "to_day"]).filter(F.col("to") > F.col("from"))
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    one = by.agg(zero(F.col("width"), "operation_days"), zero(F.col("width") * F.col("records"), "allocations"), zero(F.col("width") * F.col("need"), "balance_rows"))
    return one.crossJoin(used.agg(F.countDistinct("uid").alias("capacity_rows")))  # one row each


def simplex(cost: list[Fraction], rows: list[dict[int, Fraction]], limits: list[Fraction]) -> Fraction:
    """Largest cost'x over x >= 0 and rows x <= limits (none negative), exactly; the smallest index enters and leaves, so it ends."""
    n, m = len(cost), len(rows)
    table = [dict(r) | {n + k: Fraction(1)} for k, r in enumerate(rows)]
    right, basis = list(limits), [n + k for k in range(m)]
    gain = {j: c for j, c in enumerate(cost) if c}
    value = Fraction(0)
    while True:
        enter = min((j for j, c in gain.items() if c > 0), default=None)
        if enter is None:
            return value
        leave = min(((right[k] / table[k][enter], basis[k], k) for k in range(m) if table[k].get(enter, 0) > 0), default=None)
        if leave is None:
            raise ArithmeticError("unbounded")
        k = leave[2]
        pivot = table[k][enter]
        table[k] = {j: x / pivot for j, x in table[k].items()}
        right[k] /= pivot
        for i in range(m):
            if i != k and (f := table[i].get(enter)):
                for j, x in table[k].items():
                    table[i][j] = table[i].get(j, Fraction(0)) - f * x
                    if not table[i][j]:
                        del table[i][j]
                right[i] -= f * right[k]
        f = gain[enter]
        for j, x in table[k].items():
            gain[j] = gain.get(j, Fraction(0)) - f * x
            if not gain[j]:
                del gain[j]
        value += f * right[k]
        basis[k] = enter


def upper_bound(state: State, *, moves: str = "both", bound: int | None = None) -> dict:
    """The bound in cents and the model's size; models over MAX_VARIABLES takings are refused (``status`` says so), not solved in part."""
    found = written(candidates(state, moves, bound))
    size = model_counts(state, found).first().asDict()
    rows = variables(state, found)
    if size["allocations"] > MAX_VARIABLES:
        return {"status": "too large", "upper_bound_cents": None, **size}
    data = rows.orderBy("label", "day_index", "edge_id", "uid").collect()
    if not data:
        return {"status": "optimal", "upper_bound_cents": 0.0, **size}
    ops: dict[tuple, int] = {}
    for r in data:
        ops.setdefault((r["label"], r["day_index"]), len(ops))
    cost, face = [Fraction(0)] * (len(ops) + len(data)), {}
    balance: dict[tuple, dict[int, Fraction]] = {}
    use: dict[str, dict[int, Fraction]] = {}
    for k, r in enumerate(data):
        o, a = ops[r["label"], r["day_index"]], len(ops) + k
        cost[o] = Fraction(r["pmr_per_unit"])
        row = balance.setdefault((o, r["edge_id"]), {o: Fraction(1)})  # amount <= takings: more is never worth taking
        row[a] = Fraction(-1)
        use.setdefault(r["uid"], {})[a] = Fraction(1)
        face[r["uid"]] = Fraction(r["face"])
    value = simplex(cost, [*balance.values(), *use.values()], [Fraction(0)] * len(balance) + [face[u] for u in use])
    return {"status": "optimal", "upper_bound_cents": float(value), **size}
