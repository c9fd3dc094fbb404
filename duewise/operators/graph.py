"""Candidates and topology: two-edge paths, reciprocal pairs, bounded cycles, feasibility, degrees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.functions import scalars as S
from duewise.operators.components import strong_components, weak_components
from duewise.operators.state import capacity_events
from duewise.storage import small, written


def two_paths(edges: DataFrame) -> DataFrame:
    """(payer, intermediary, payee, in_edge, out_edge, bilateral) of all two-edge paths."""
    left = edges.select(F.col("u").alias("payer"), F.col("v").alias("intermediary"), F.col("edge_id").alias("in_edge"))
    right = edges.select(F.col("u").alias("intermediary"), F.col("v").alias("payee"), F.col("edge_id").alias("out_edge"))
    return left.join(right, "intermediary").withColumn("bilateral", F.col("payer") == F.col("payee"))


def two_path_counts(edges: DataFrame) -> DataFrame:
    """(intermediary, paths, reciprocal): numbers of ``two_paths`` through each firm, from its edges in and out; no path is made."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1).alias("back"))
    both = edges.select("u", "v").join(back, ["u", "v"], "left")
    ends = both.select(F.col("v").alias("intermediary"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.coalesce("back", F.lit(0)).alias("r")).union(both.select("u", F.lit(0), F.lit(1), F.lit(0)))
    counts = ends.groupBy("intermediary").agg((F.sum("i") * F.sum("o")).alias("paths"), F.sum("r").alias("reciprocal"))
    return counts.filter("paths > 0")


def intermediaries(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("node_id")).intersect(edges.select("u"))


def reciprocal_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, forward_edge, back_edge), a < b, of edges in both directions."""
    back = edges.select(F.col("v").alias("a"), F.col("u").alias("b"), F.col("edge_id").alias("back_edge"))
    return edges.filter("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("edge_id").alias("forward_edge")).join(back, ["a", "b"])


def cycles(edges: DataFrame, bound: int = 8, *, feasible_days: DataFrame | None = None) -> DataFrame:
    """(nodes, edges) of all elementary cycles of 2 to ``bound`` edges, each from its smallest node.

    One join a length; open paths never pass below their start nor through a node twice. Paths that lack two edges to the bound
    are not grown but closed by two edges at once (``closed_by_two``), so the longest open paths, by far the most, are never made.
    With ``feasible_days`` (edge_id, days: array of day words) paths that have no day in common are pruned.
    """
    if bound < 2:
        raise ValueError("cycles have two edges at least")
    step = edges.select(F.col("u").alias("s_u"), F.col("v").alias("s_v"), F.col("edge_id").alias("s_edge"))
    if feasible_days is not None:
        step = step.join(feasible_days.select(F.col("edge_id").alias("s_edge"), F.col("days").alias("s_days")), "s_edge")
    step = written(step)
    days = ["days"] if feasible_days is not None else []
    start = step.filter("s_u < s_v").select(F.col("s_u").alias("start"), F.col("s_v").alias("end"), F.array("s_u", "s_v").alias("nodes"), F.array("s_edge").alias("edges"), *([F.col("s_days").alias("days")] if days else []))
    frontier, found = start, None
    common = F.zip_with("days", "s_days", lambda a, b: F.coalesce(a.bitwiseAND(b), F.lit(0).cast("bigint")))
    met = lambda rows: rows.withColumn("days", common).filter(F.exists("days", lambda w: w != 0)) if days else rows
    for length in range(2, bound + 1):
        back = step.withColumnsRenamed({"s_u": "end", "s_v": "start"})
        closed = met(frontier.join(back, ["end", "start"])).select("nodes", F.concat("edges", F.array("s_edge")).alias("edges"), *days)
        found = closed if found is None else found.unionByName(closed)
        if length == bound - 1:
            rows = closed_by_two(frontier, step, bool(days))
            rows = met(rows.join(step.withColumnsRenamed({"s_u": "end", "s_v": "next"}), ["end", "next"])).select("start", "next", "nodes", F.concat("edges", F.array("s_edge")).alias("edges"), *days)
            rows = met(rows.join(step.withColumnsRenamed({"s_u": "next", "s_v": "start"}), ["next", "start"]))
            return found.unionByName(rows.select(F.concat("nodes", F.array("next")).alias("nodes"), F.concat("edges", F.array("s_edge")).alias("edges"), *days))
        if length < bound:
            grown = met(frontier.join(step, (frontier["end"] == step["s_u"]) & (step["s_v"] > frontier["start"]))).filter(~F.array_contains("nodes", F.col("s_v")))
            frontier = written(grown.select("start", F.col("s_v").alias("end"), F.concat("nodes", F.array("s_v")).alias("nodes"), F.concat("edges", F.array("s_edge")).alias("edges"), *days))
            if frontier.isEmpty():
                break
    return found


#: Edges whose neighbour lists one task of ``closed_by_two`` holds on either side, and paths by one edge that it looks at at once.
HELD_EDGES, AT_ONCE = 4_000_000, 4_000_000


def closed_by_two(paths: DataFrame, step: DataFrame, timed: bool) -> DataFrame:
    """``paths`` (start, end, nodes, edges[, days]) with each node ``next`` that an edge from ``end`` leads to and an edge to ``start`` leaves.

    Starts and ends are hashed to buckets, and each pair of buckets is a group: the paths between both, the successors of the one's
    ends and the predecessors of the other's starts, packed as one row a node. So nothing is made for a path that doesn't close.
    With ``timed``, all edges have a day in common by their first and last days; whether by all days is left to the caller.
    """
    n = 3 + step.count() // HELD_EDGES
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def ends_of(c: str) -> tuple:
        """First and last day of an array of day words, to the word."""
        set_ = F.transform(c, lambda w: w != 0)
        first = F.array_position(set_, True).cast("int") - 1
        return first, F.size(c) - F.array_position(F.reverse(set_), True).cast("int")

    first, last = ends_of("s_days") if timed else (F.lit(0), F.lit(0))
    sides = step.select("s_u", "s_v", first.alias("a"), last.alias("b"))
    packed = lambda key, other: sides.groupBy(F.col(key).alias("node")).agg(F.collect_list(F.struct(F.col(other).alias("n"), "a", "b")).alias("x")).select("node", F.col("x.n").alias("near"), F.col("x.a").alias("firsts"), F.col("x.b").alias("lasts"))
    outs = packed("s_u", "s_v").select(F.lit(1).alias("what"), every.alias("_i"), bucket("node").alias("_j"), "node", "near", "firsts", "lasts")
    ins = packed("s_v", "s_u").select(F.lit(2).alias("what"), bucket("node").alias("_i"), every.alias("_j"), "node", "near", "firsts", "lasts")
    first, last = ends_of("days") if timed else (F.lit(0), F.lit(0))
    days = ["days"] if timed else []
    own = paths.select(F.lit(0).alias("what"), bucket("start").alias("_i"), bucket("end").alias("_j"), "start", "end", "nodes", "edges", *days, first.alias("a"), last.alias("b"))
    rows = own.unionByName(outs.unionByName(ins), allowMissingColumns=True)
    kept = ["start", "end", "nodes", "edges", *days]
    schema = ", ".join(f"{c} {dict(paths.dtypes)[c]}" for c in kept) + f", next {dict(step.dtypes)['s_v']}"

    def close(group: pa.Table) -> pa.Table:
        what = group["what"].to_numpy()
        part = lambda k: group.filter(pa.array(what == k)).combine_chunks()
        own, sides = part(0), []
        column = lambda t, c: t[c].to_numpy().astype(np.int64)
        flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(t) else np.zeros(0, np.int64)
        for k in (1, 2):
            t = part(k)
            order = np.argsort(node := column(t, "node"))
            sizes = t["near"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(t) else np.zeros(0, np.int64)
            begin = np.cumsum(sizes) - sizes
            sides.append((node[order], begin[order], sizes[order], flat(t, "near"), flat(t, "firsts"), flat(t, "lasts")))
        (o_node, o_begin, o_size, o_near, o_first, o_last), (i_node, i_begin, i_size, i_near, i_first, i_last) = sides
        picked, nexts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(own) and len(o_node) and len(i_node):
            starts, ends, p_first, p_last = (column(own, c) for c in ("start", "end", "a", "b"))
            known = np.unique(i_near)
            o_code = np.minimum(np.searchsorted(known, o_near), len(known) - 1)
            o_code = np.where(known[o_code] == o_near, o_code, len(known))  # a successor that no predecessor list holds stands for none
            i_code = np.searchsorted(known, i_near)
            at = np.full(len(known) + 1, -1, np.int64)
            order = np.argsort(starts, kind="stable")
            to = np.minimum(np.searchsorted(o_node, ends), len(o_node) - 1)
            width = np.where(o_node[to] == ends, o_size[to], 0)
            cuts = np.flatnonzero(np.diff(starts[order])) + 1
            for mine in np.split(order, cuts):
                k = np.searchsorted(i_node, starts[mine[0]])
                if k == len(i_node) or i_node[k] != starts[mine[0]]:
                    continue
                here = np.arange(i_begin[k], i_begin[k] + i_size[k])
                here = here[i_near[here] > starts[mine[0]]]
                at[i_code[here]] = here
                run = np.cumsum(width[mine]) // AT_ONCE
                for some in np.split(mine, np.flatnonzero(np.diff(run)) + 1):
                    w = width[some]
                    row = np.repeat(some, w)
                    edge = np.arange(len(row)) + np.repeat(o_begin[to[some]] - np.cumsum(w) + w, w)
                    other = at[o_code[edge]]
                    hit = np.flatnonzero(other >= 0)
                    row, edge, other = row[hit], edge[hit], other[hit]
                    meets = np.maximum(np.maximum(p_first[row], o_first[edge]), i_first[other]) <= np.minimum(np.minimum(p_last[row], o_last[edge]), i_last[other])
                    picked.append(row[meets])
                    nexts.append(o_near[edge[meets]].astype(np.int64))
                at[i_code[here]] = -1
        out = own.select(kept).take(pa.array(np.concatenate(picked)))
        return out.append_column("next", pa.array(np.concatenate(nexts)).cast(group.schema.field("node").type))

    return rows.groupBy("_i", "_j").applyInArrow(close, schema).filter(~F.array_contains("nodes", F.col("next")))


def day_sets(residuals: DataFrame) -> DataFrame:
    """(edge_id, days): days with capacity as 64-bit words, set by stretches of days."""
    return capacity_events(residuals).groupBy("edge_id").agg(S.stretch_words(F.collect_list(F.struct("day_from", "day_to"))).alias("days"))


def inventory(found: DataFrame) -> DataFrame:
    """(length, cycles)."""
    return found.groupBy(F.size("nodes").alias("length")).agg(F.count(F.lit(1)).alias("cycles"))


def _met_stretches(found: DataFrame, residuals: DataFrame) -> DataFrame:
    """(nodes, edges, met): for each cycle an array of the stretches of days (day_from, day_to, capacity) that all its edges share.

    An edge's stretches travel as one row, and a cycle's are met with each other inside its row.
    """
    own = capacity_events(residuals).groupBy("edge_id").agg(F.collect_list(F.struct("day_from", "day_to", "capacity")).alias("own"))
    rows = found.select("nodes", "edges", F.explode("edges").alias("edge_id")).join(own, "edge_id").groupBy("nodes", "edges").agg(F.collect_list("own").alias("own"))

    def meet(a, b):
        both = lambda x, y: F.struct(F.greatest(x["day_from"], y["day_from"]).alias("day_from"), F.least(x["day_to"], y["day_to"]).alias("day_to"), F.least(x["capacity"], y["capacity"]).alias("capacity"))
        return F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: (y["day_from"] <= x["day_to"]) & (x["day_from"] <= y["day_to"])), lambda y: both(x, y))))

    rows = rows.filter(F.size("own") == F.size("edges"))  # an edge without days leaves none to the cycle
    return rows.select("nodes", "edges", F.aggregate(F.slice("own", 2, F.size("own")), F.element_at("own", 1), meet).alias("met")).filter(F.size("met") > 0)


def feasible_stretches(found: DataFrame, residuals: DataFrame) -> DataFrame:
    """(nodes, edges, day_from, day_to, amount_cents): stretches of days on which a cycle can clear one and the same amount."""
    return _met_stretches(found, residuals).select("nodes", "edges", F.inline("met")).withColumnRenamed("capacity", "amount_cents")


def best_days(found: DataFrame, residuals: DataFrame) -> DataFrame:
    """(nodes, edges, amount_cents, day_index): the most that each cycle can clear on one day, and the earliest such day."""
    best = F.array_max(F.transform("met", lambda x: F.struct(x["capacity"].alias("amount_cents"), (-x["day_from"]).alias("back"))))
    return _met_stretches(found, residuals).withColumn("best", best).select("nodes", "edges", "best.amount_cents", (-F.col("best.back")).alias("day_index"))


def feasible_day_sums(found: DataFrame, residuals: DataFrame) -> DataFrame:
    """(day_index, cycles, amount_cents, largest) of the cycles that can clear something on a day, added up by stretch before days are made."""
    sums = feasible_stretches(found, residuals).groupBy("day_from", "day_to").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("amount"), F.max("amount_cents").alias("most"))
    days = sums.select(F.explode(F.sequence("day_from", "day_to")).alias("day_index"), "n", "amount", "most").groupBy("day_index")
    return days.agg(F.sum("n").alias("cycles"), F.sum("amount").alias("amount_cents"), F.max("most").alias("largest"))


def feasible_cycle_days(found: DataFrame, residuals: DataFrame) -> DataFrame:
    """(nodes, edges, day_index, amount_cents) of each day on which a cycle can clear something."""
    return feasible_stretches(found, residuals).select("nodes", "edges", F.explode(F.sequence("day_from", "day_to")).alias("day_index"), "amount_cents")


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, n_in, n_out) of ``pairs`` (u, v)."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(pairs.select("v", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def topology(records: DataFrame) -> DataFrame:
    """One row of thirteen measures of the graph of all ``records``; the opportunity ratio is infinite without cyclic paths."""
    pairs = written(records.select(F.col("debtor").alias("u"), F.col("creditor").alias("v")).distinct())
    links = pairs.select(F.col("u").alias("a"), F.col("v").alias("b"))
    weak, strong = written(weak_components(links)), written(strong_components(links))
    share = lambda c, name: c.groupBy("component").count().agg(F.count(F.lit(1)).alias(f"{name}_components"), F.max("count").alias(f"{name}_largest"))
    sized = strong.groupBy("component").count().filter("count > 1").select("component")
    cyclic = strong.join(small(sized), "component", "left_semi").select("node", F.lit(True).alias("cyclic"))
    by = degrees(pairs).join(cyclic, "node", "left").withColumn("paths", F.col("n_in") * F.col("n_out"))
    one = by.agg(F.count(F.lit(1)).alias("firms"), F.count("cyclic").alias("firms_nontrivial_scc"), F.coalesce(F.sum("paths"), F.lit(0)).alias("local_two_edge_paths"), F.coalesce(F.sum(F.when(F.col("cyclic"), F.col("paths"))), F.lit(0)).alias("cyclic_local_two_edge_paths"))
    back = pairs.join(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi").agg(F.count(F.lit(1)).alias("back"))
    row = one.crossJoin(pairs.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(back).crossJoin(share(weak, "weak")).crossJoin(share(strong, "strong"))  # one row each
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n, m = F.col("firms"), F.col("edges")
    return row.select(
        "firms", "edges", ratio(m, n * (n - 1)).alias("directed_density"), ratio(F.col("back"), m).alias("reciprocity"), "weak_components", ratio(F.col("weak_largest"), n).alias("largest_wcc_share"),
        "strong_components", ratio(F.col("strong_largest"), n).alias("largest_scc_share"), "firms_nontrivial_scc", "local_two_edge_paths", "cyclic_local_two_edge_paths",
        ratio(F.col("cyclic_local_two_edge_paths"), F.col("local_two_edge_paths")).alias("cycle_closure_ratio"),
        F.when(F.col("cyclic_local_two_edge_paths") > 0, F.col("local_two_edge_paths") / F.col("cyclic_local_two_edge_paths")).otherwise(float("inf")).alias("topological_opportunity_ratio"),
    )


def topology_hash(state) -> str:
    """SHA-256 over the edges in their order."""
    label = lambda name, key: state.nodes.select(F.col("node_id").alias(key), F.col("label").alias(name))
    lines = state.edges.join(label("debtor", "u"), "u").join(label("creditor", "v"), "v").select("edge_id", S.topology_line(F.col("debtor"), F.col("creditor")).alias("line"))
    import hashlib

    digest = hashlib.sha256()
    for r in lines.orderBy("edge_id").toLocalIterator():
        digest.update(r["line"].encode())
    return digest.hexdigest()
