"""Clearing policies, run whole in one task for each weak component; everything around them is relational.

A move touches only edges of one component, so components never interact; ids of firms and edges stay global, and so do ties.
"""

from __future__ import annotations

import bisect
import heapq  # noqa: F401 (tests count the heaps)
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.operators import firmwise
from duewise.operators.components import weak_components
from duewise.operators.state import State
from duewise.schema import FRAGMENTS
from duewise.storage import small, written

POLICIES = ("path_daily_local", "path_daily", "path_daily_amount", "path_offline_local", "path_offline", "path_offline_amount", "cycle_daily", "cycle_offline", "mixed_cycle_then_path", "mixed_path_then_cycle")


class Market:
    """Residual records of one component on one day after the other, in plain terms: what the kernels (``firmwise``) are compared with."""

    def __init__(self, rows: pd.DataFrame, horizon: int, dense: bool = False):
        if dense:
            raise ValueError("capacities of all days are kept by firmwise")
        self.horizon, self.ends = horizon, {}
        rows = rows.sort_values(["edge_id", "due_ordinal", "issue_ordinal", "uid"], ignore_index=True)
        self.uid, self.left = rows["uid"].tolist(), rows["residual"].tolist()
        self.issue, self.due = rows["issue_index"].tolist(), rows["due_index"].tolist()
        self.ordinals = list(zip(rows["issue_ordinal"].tolist(), rows["due_ordinal"].tolist(), strict=True))
        self.edge = rows["edge_id"].tolist()
        self.records: dict[int, list[int]] = defaultdict(list)
        for k, (e, u, v) in enumerate(zip(self.edge, rows["u"].tolist(), rows["v"].tolist(), strict=True)):
            self.records[e].append(k)
            self.ends[e] = (u, v)
        self.incoming, self.outgoing = defaultdict(list), defaultdict(list)
        for e in sorted(self.ends):
            u, v = self.ends[e]
            self.outgoing[u].append(e)
            self.incoming[v].append(e)
        self.middle = sorted(self.incoming.keys() & self.outgoing.keys())
        self.cap = dict.fromkeys(self.ends, 0)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.close: dict[int, list[int]] = defaultdict(list)
        for k in range(len(self.uid)):
            self.open[self.issue[k]].append(k)
            self.close[self.due[k] + 1].append(k)
        self.live: dict[int, list[int]] = defaultdict(list)
        self.crossings: dict[int, Crossing] = {}

    def crossing(self, firm: int) -> Crossing:
        """The paths through ``firm``, sorted once and then kept up with each edge that changes."""
        if (found := self.crossings.get(firm)) is None:
            found = self.crossings[firm] = Crossing(self, firm)
        return found

    def changed(self, edge: int) -> None:
        """The capacity of ``edge`` has changed: both its firms look at it again."""
        u, v = self.ends[edge]
        if (found := self.crossings.get(v)) is not None:
            found.turn(found.ins, found.by_in, found.by_out, u, edge)
        if (found := self.crossings.get(u)) is not None:
            found.turn(found.outs, found.by_out, found.by_in, v, edge)

    def dawn(self, day: int) -> set[int]:
        """Moves to ``day``; the edges on which something was issued that day. All other capacities only fall."""
        for k in self.close[day]:
            self.cap[self.edge[k]] -= self.left[k]
            if k in self.live[self.edge[k]]:
                self.live[self.edge[k]].remove(k)
        for k in self.open[day]:
            self.cap[self.edge[k]] += self.left[k]
            bisect.insort(self.live[self.edge[k]], k)  # records are numbered in consumption order within an edge
        if self.crossings:
            for e in {self.edge[k] for ks in (self.close[day], self.open[day]) for k in ks}:
                self.changed(e)
        return {self.edge[k] for k in self.open[day]}

    def take(self, edge: int, day: int, amount: int) -> list[tuple]:
        """Consumes ``amount`` of the records active on ``day``, in consumption order; their fragments."""
        out, rest = [], amount
        self.cap[edge] -= amount
        self.changed(edge)
        for k in list(self.live[edge]):
            q = min(rest, self.left[k])
            self.left[k] -= q
            rest -= q
            if not self.left[k]:
                self.live[edge].remove(k)
            out.append((self.uid[k], q, self.issue[k], self.due[k], *self.ordinals[k]))
            if not rest:
                return out
        raise AssertionError(f"edge {edge} is short of {rest} on day {day}")


def leading(ins: list[tuple], outs: list[tuple]) -> tuple | None:
    """Key of the best non-bilateral path of sorted sides (-capacity, firm, edge): first with first, else one side's second."""
    if not ins or not outs:
        return None
    pairs = [(ins[0], outs[0])] if ins[0][1] != outs[0][1] else [(i, o) for i, o in ((ins[1:2], outs[:1]), (ins[:1], outs[1:2])) if i and o]
    pairs = [(i[0], o[0]) if isinstance(i, list) else (i, o) for i, o in pairs]
    keys = [(max(i[0], o[0]), max(i[0], o[0]), 1, i[1], o[1], i[2], o[2]) for i, o in pairs]
    return min(keys, default=None)


class Crossing:
    """The paths through one firm, kept sorted while capacities change."""

    def __init__(self, market: Market, firm: int):
        cap, ends = market.cap, market.ends
        self.market = market
        self.ins = sorted((-cap[e], ends[e][0], e) for e in market.incoming[firm] if cap[e] > 0)
        self.outs = sorted((-cap[e], ends[e][1], e) for e in market.outgoing[firm] if cap[e] > 0)
        self.by_in, self.by_out = {x[1]: x for x in self.ins}, {x[1]: x for x in self.outs}
        self.back = sorted(self.mutual(f) for f in self.by_in.keys() & self.by_out.keys())

    def mutual(self, firm: int) -> tuple:
        i, o = self.by_in[firm], self.by_out[firm]
        q = max(i[0], o[0])
        return 2 * q, q, 0, firm, firm, i[2], o[2]

    def best(self) -> tuple | None:
        """The least key (-score, -amount, ...): a reciprocal path scores twice its amount."""
        return min((k for k in (leading(self.ins, self.outs), self.back[0] if self.back else None) if k), default=None)

    def turn(self, side: list[tuple], by: dict[int, tuple], across: dict[int, tuple], firm: int, edge: int) -> None:
        """The capacity of ``edge``, to or from ``firm`` on one ``side``, has changed."""
        old, c = by.get(firm), self.market.cap[edge]
        if old is not None:
            if firm in across:
                _drop(self.back, self.mutual(firm))
            _drop(side, by.pop(firm))
        if c > 0:
            by[firm] = (-c, firm, edge)
            bisect.insort(side, by[firm])
            if firm in across:
                bisect.insort(self.back, self.mutual(firm))


def _drop(side: list[tuple], x: tuple) -> None:
    """Takes ``x`` out of a sorted list that holds it."""
    del side[bisect.bisect_left(side, x)]


def clear(rows: pd.DataFrame, cycles: list[tuple], policy: str, horizon: int) -> list[tuple]:
    """All fragments of one component under one policy."""
    lists = lambda k: pa.array([list(c[k]) for c in cycles], pa.list_(pa.int64()))
    loops = firmwise.Cycles(lists(0), lists(1)) if policy.startswith(("cycle", "mixed")) else None
    parts = firmwise.fragments(pa.Table.from_pandas(rows[firmwise.COLUMNS], preserve_index=False), policy, horizon, loops)
    return [row for part in parts for row in zip(*(x.tolist() for x in part.values()), strict=True)]


def run_policy(state: State, policy: str, *, cycles: DataFrame | None = None, run_id: str = "") -> DataFrame:
    """The fragments (schema FRAGMENTS) of ``policy`` over all components of ``state``; one task for a component.

    ``cycles``: (nodes, edges) for policies that use them. A record set that is one component runs in one task: runs over other
    policies, phases and variants are what is parallel then.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {', '.join(POLICIES)}")
    needs_cycles = policy.startswith(("cycle", "mixed"))
    if needs_cycles and cycles is None:
        raise ValueError(f"{policy} needs cycles")
    parts = weak_components(state.edges.select(F.col("u").cast("bigint").alias("a"), F.col("v").cast("bigint").alias("b")))
    parts = written(parts.select(F.col("node").cast("int").alias("u"), "component"))
    parts = small(parts)
    rows = state.residuals.join(parts, "u").select("component", F.lit(0).alias("what"), "edge_id", "u", "v", "uid", "residual", "issue_index", "due_index", "issue_ordinal", "due_ordinal", F.lit(None).cast("array<int>").alias("nodes"), F.lit(None).cast("array<int>").alias("edges"))
    if needs_cycles:
        loops = cycles.select(F.element_at("nodes", 1).alias("u"), "nodes", "edges").join(parts, "u")
        if policy.startswith("cycle"):  # nothing else is ever looked at
            rows = rows.join(cycles.select(F.explode("edges").alias("edge_id")).distinct(), "edge_id", "left_semi")
        rows = rows.unionByName(loops.select("component", F.lit(1).alias("what"), "nodes", "edges"), allowMissingColumns=True)
    horizon = state.horizon
    names = [x.split()[0] for x in FRAGMENTS.split(", ")]

    def kernel(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, loops = pa.Table.from_batches(batches), None
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
        kinds = {n: kinds[x.split()[1]] for n, x in zip(names, FRAGMENTS.split(", "), strict=True)}
        if needs_cycles:
            of = found.filter(pc.equal(found["what"], 1)).select(["nodes", "edges"]).combine_chunks()
            loops = firmwise.Cycles(*(pa.concat_arrays(of[c].chunks) if of[c].num_chunks else pa.array([], of[c].type) for c in ("nodes", "edges")))
            found = found.filter(pc.equal(found["what"], 0))
        for part in firmwise.fragments(found.select(firmwise.COLUMNS), policy, horizon, loops):
            part |= {"run_id": pa.repeat(run_id, len(part["op_seq"])), "component": np.full(len(part["op_seq"]), key[0].as_py())}
            yield pa.RecordBatch.from_arrays([(x if isinstance(x := part[n], pa.Array) else pa.array(x)).cast(kinds[n]) for n in names], names=names)

    columns = ["what", *firmwise.COLUMNS, "nodes", "edges"] if needs_cycles else firmwise.COLUMNS
    return rows.select("component", *columns).groupBy("component").applyInArrow(kernel, FRAGMENTS)


def operations(fragments: DataFrame) -> DataFrame:
    """One row for each operation of a fragment table."""
    return fragments.select("run_id", "component", "op_seq", "kind", "day_index", "op_amount", "payer", "intermediary", "payee", "bilateral", "pmr_cents", "nodes").distinct()


