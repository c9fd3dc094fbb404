import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from duewise.operators import attribution as att
from duewise.operators import clearing, graph
from duewise.operators.replay import ReplayError, demand_pass, replay, residual_records
from duewise.operators.state import build_state

SPAN = ("2025-01-01", "2025-01-12")
GOLDEN = {
    "path_daily_local": (4, 16000, 16000, 6000), "path_daily": (4, 16000, 16000, 6000), "cycle_daily": (1, 15000, 0, 23000), "path_offline": (3, 16000, 16000, 6000), "cycle_offline": (1, 15000, 0, 23000),
    "mixed_cycle_then_path": (4, 16000, 16000, 6000), "mixed_path_then_cycle": (4, 16000, 16000, 6000),
}


@pytest.mark.parametrize("policy", GOLDEN)
def test_six_record_network(six, policy):
    state = build_state(six, *SPAN)
    fragments = clearing.run_policy(state, policy, cycles=graph.cycles(state.edges, 8)).cache()
    row, checked = att.summary(fragments).first(), demand_pass(replay(state, fragments))
    assert (row["operations"], row["pmr_cents"], row["instruction_mass_cents"], checked["residual_mass_cents"]) == GOLDEN[policy]
    if policy == "path_daily_local":
        curve = [r["pmr_cents"] for r in att.pmr_curve(fragments, state.horizon).orderBy("day_index").collect()]
        assert curve == [0, 6000, 14000, 14000] + [16000] * 8
        assert (row["compression_cents"], row["mean_acceleration_days"], row["positive_only_mean_days"], row["accelerated_mass_share"]) == (32000, 2.5, 5.0, 0.5)
    if policy == "cycle_daily":
        op = clearing.operations(fragments).first()
        assert (op["day_index"], op["op_amount"], list(op["nodes"])) == (4, 5000, [0, 1, 2])


def test_schedules_of_the_regime_instance(records):
    state = build_state(records([("ab", "A", "B", 10, 1, 3), ("bc", "B", "C", 10, 3, 3), ("bd", "B", "D", 6, 1, 1), ("eb", "E", "B", 6, 2, 3)]), "2025-01-01", "2025-01-03")
    value = lambda p: att.summary(clearing.run_policy(state, p)).first()["pmr_cents"]
    assert value("path_offline") == 10 and value("path_daily") == 16


class Plain:
    """Policies by definition: capacities are summed anew for every look."""

    def __init__(self, rows, horizon):
        self.rows = [dict(r) for r in rows]
        self.horizon, self.log = horizon, []
        self.ends = {r["edge_id"]: (r["u"], r["v"]) for r in rows}

    def cap(self, e, day):
        return sum(r["residual"] for r in self.rows if r["edge_id"] == e and r["issue_index"] <= day <= r["due_index"])

    def use(self, edges, day, q, what):
        for e in edges:
            rest = q
            for r in sorted((r for r in self.rows if r["edge_id"] == e and r["issue_index"] <= day <= r["due_index"]), key=lambda r: (r["due_ordinal"], r["issue_ordinal"], r["uid"])):
                x = min(rest, r["residual"])
                r["residual"] -= x
                rest -= x
            assert rest == 0
        self.log.append((day, q, what, tuple(edges)))

    def best(self, firm, day):
        ins = sorted((-c, self.ends[e][0], e) for e in self.ends if self.ends[e][1] == firm and (c := self.cap(e, day)))
        outs = sorted((-c, self.ends[e][1], e) for e in self.ends if self.ends[e][0] == firm and (c := self.cap(e, day)))
        keys = []
        if ins and outs:
            pairs = [(0, 0)] if ins[0][1] != outs[0][1] else [(1, 0), (0, 1)]
            for i, j in pairs:
                if i < len(ins) and j < len(outs):
                    q = min(-ins[i][0], -outs[j][0])
                    keys.append((-q, -q, 1, ins[i][1], outs[j][1], ins[i][2], outs[j][2]))
        for a in ins:
            for b in outs:
                if a[1] == b[1]:
                    q = min(-a[0], -b[0])
                    keys.append((-2 * q, -q, 0, a[1], a[1], a[2], b[2]))
        return min(keys, default=None)

    def firms(self):
        return sorted({u for u, _ in self.ends.values()} & {v for _, v in self.ends.values()})

    def local(self, day):
        for f in self.firms():
            while key := self.best(f, day):
                self.use(key[5:], day, -key[1], f)

    def world(self, day):
        todo = sorted((k, f) for f in self.firms() if (k := self.best(f, day)))
        while todo:
            key, f = todo.pop(0)
            if key == (now := self.best(f, day)):
                self.use(key[5:], day, -key[1], f)
                now = self.best(f, day)
            if now:
                todo = sorted([*todo, (now, f)])

    def rounds(self, cycles, day):
        while found := [(-len(n) * q, len(n), n, e) for n, e in cycles if (q := min(self.cap(x, day) for x in e))]:
            score, size, nodes, edges = min(found)
            self.use(edges, day, -score // size, nodes)

    def common(self, edges):
        return max((min(self.cap(e, d) for e in edges), -d) for d in range(self.horizon))

    def anytime(self, candidates, key, what):
        while found := [(key(c, q, -back), c, q, -back) for c in candidates for q, back in [self.common(c[-1])] if q]:
            _, c, q, day = min(found, key=lambda x: x[0])
            self.use(c[-1], day, q, what(c))


def random_market(seed):
    rng = random.Random(seed)
    firms, horizon = rng.randint(3, 5), 6
    rows, ids = [], {}
    for k in range(rng.randint(6, 16)):
        u, v = rng.sample(range(firms), 2)
        i = rng.randrange(horizon)
        j = min(horizon - 1, i + rng.randrange(4))
        ids.setdefault((u, v), None)
        rows.append({"u": u, "v": v, "uid": f"x{rng.randrange(1000)}-{k}", "residual": rng.choice([1, 2, 2, 3, 5, 8]), "issue_index": i, "due_index": j, "issue_ordinal": 100 + i, "due_ordinal": 100 + j + rng.randrange(2)})
    for n, pair in enumerate(sorted(ids)):
        ids[pair] = n
    for r in rows:
        r["edge_id"] = ids[r["u"], r["v"]]
    loops = []

    def grow(path):
        for (u, v), _ in ids.items():
            if u == path[-1]:
                if v == path[0]:
                    loops.append(tuple(path))
                elif v > path[0] and v not in path:
                    grow([*path, v])

    for f in range(firms):
        grow([f])
    loops = sorted(loops, key=lambda n: (len(n), n))
    return rows, [(n, tuple(ids[a, b] for a, b in zip(n, n[1:] + n[:1], strict=True))) for n in loops], horizon


@pytest.mark.parametrize("policy", clearing.POLICIES)
def test_policies_equal_plain_definitions(policy):
    for seed in range(40):
        rows, cycles, horizon = random_market(seed)
        plain = Plain(rows, horizon)
        through = lambda f, p=plain: [(f, p.ends[i][0], p.ends[o][1], (i, o)) for i in p.ends if p.ends[i][1] == f for o in p.ends if p.ends[o][0] == f]
        w = lambda c: 2 if c[1] == c[2] else 1
        if policy == "cycle_offline":
            plain.anytime(cycles, lambda c, q, d: (-len(c[0]) * q, len(c[0]), c[0], d), lambda c: c[0])
        elif policy == "path_offline":
            plain.anytime([c for f in plain.firms() for c in through(f)], lambda c, q, d: (-w(c) * q, -q, d, 2 - w(c), *c[:3], *c[3]), lambda c: c[0])
        elif "offline" in policy:
            for f in plain.firms():
                plain.anytime(through(f), (lambda c, q, d: (-w(c) * q, -q, d, 2 - w(c), *c[1:3], *c[3])) if "local" in policy else (lambda c, q, d: (-q, d, *c[1:3], *c[3])), lambda c: c[0])
        else:
            for day in range(horizon):
                if policy == "path_daily_amount":
                    for f in plain.firms():
                        side = lambda k, f=f, d=day: sorted((-c, plain.ends[e][1 - k], e) for e in plain.ends if plain.ends[e][k] == f and (c := plain.cap(e, d)))
                        while (a := side(1)) and (b := side(0)):
                            plain.use((a[0][2], b[0][2]), day, min(-a[0][0], -b[0][0]), f)
                    continue
                if policy in ("cycle_daily", "mixed_cycle_then_path"):
                    plain.rounds(cycles, day)
                if policy == "path_daily_local":
                    plain.local(day)
                if policy == "path_daily" or "mixed" in policy:
                    plain.world(day)
                if policy == "mixed_path_then_cycle":
                    plain.rounds(cycles, day)
        got = {}
        for r in clearing.clear(pd.DataFrame(rows), cycles, policy, horizon):
            op = got.setdefault(r[0], [r[2], r[3], tuple(r[9]) if r[1] == "cycle" else r[5], []])
            if r[11] not in op[3]:
                op[3].append(r[11])
        assert [(d, q, x, tuple(e)) for d, q, x, e in got.values()] == plain.log, (policy, seed)


TAMPERINGS = {
    "temporal_violations": ("day_index", "11"),
    "bad_edge_fragments": ("uid", "if(uid = 'r1', 'nobody', uid)"),
    "overconsumed_fragments": ("amount_cents", "amount_cents * 3"),
    "bad_sums": ("amount_cents", "amount_cents - 1"),
    "bad_bilateral_flags": ("bilateral", "true"),
    "malformed_operations": ("intermediary", "intermediary + 1"),
    "max_net_error_cents": ("payee", "payee + 1"),
}


@pytest.mark.parametrize("counter", TAMPERINGS)
def test_replay_notices_tampering(six, counter):
    state = build_state(six, *SPAN)
    fragments = clearing.run_policy(state, "path_daily_local").withColumn(TAMPERINGS[counter][0], F.expr(TAMPERINGS[counter][1]))
    report = replay(state, fragments)
    row = report.first()
    assert row[counter] > 0 and not row["all_pass"]
    with pytest.raises(ReplayError):
        demand_pass(report)


def test_residual_records_keep_what_lies_outside(six, records):
    state = build_state(six, *SPAN)
    late = six.union(records([("late", "A", "B", 7, 40, 50)]))
    left = {r["uid"]: r["amount_cents"] for r in residual_records(late, clearing.run_policy(state, "path_daily_local")).collect()}
    assert left == {"r3": 3000, "r6": 3000, "late": 7}


def test_guards(six):
    state = build_state(six, *SPAN)
    with pytest.raises(ValueError, match="needs cycles"):
        clearing.run_policy(state, "cycle_daily")
    with pytest.raises(ValueError, match="unknown policy"):
        clearing.run_policy(state, "x")
    with pytest.raises(ValueError, match="no record"):
        build_state(six, "2030-01-01", "2030-01-02")
    with pytest.raises(ValueError, match="two edges"):
        graph.cycles(state.edges, 1)


def test_crossings_are_sorted_once_a_firm(monkeypatch):
    rng, made, names = random.Random(6), [], ["edge_id", "u", "v", "uid", "residual", "issue_index", "due_index", "issue_ordinal", "due_ordinal"]
    rows = []
    for k in range(120):
        u, v = rng.sample(range(6), 2)
        i = rng.randrange(30)
        j = min(29, i + rng.randrange(9))
        rows.append((u * 10 + v, u, v, f"r{k}", rng.randint(1, 99), i, j, i, j))
    build = clearing.Crossing.__init__
    monkeypatch.setattr(clearing.Crossing, "__init__", lambda self, market, firm: (made.append(firm), build(self, market, firm))[1])
    for policy in ("path_daily", "path_daily_local", "path_daily_amount", "mixed_path_then_cycle"):
        made.clear()
        out = clearing.clear(pd.DataFrame(rows, columns=names), [((0, 1), (1, 10))], policy, 30)
        assert out and len(made) == len(set(made)) <= 6
    market = clearing.Market(pd.DataFrame(rows, columns=names), 30, False)
    for day in range(30):  # what is kept up is what would be sorted anew
        market.dawn(day)
        for firm in market.middle:
            kept, new = market.crossing(firm), clearing.Crossing(market, firm)
            assert (kept.ins, kept.outs, kept.back) == (new.ins, new.outs, new.back)
            if (key := kept.best()) is not None:
                market.take(key[5], day, 1)
                market.take(key[6], day, 1)


def test_offline_paths_hold_one_entry_an_edge(monkeypatch):
    names = ["edge_id", "u", "v", "uid", "residual", "issue_index", "due_index", "issue_ordinal", "due_ordinal"]
    pairs = [(a, 5) for a in range(5)] + [(5, a) for a in range(5)]
    frame = pd.DataFrame([(k, u, v, f"r{k}", 3 + k, 0, 4, 0, 4) for k, (u, v) in enumerate(pairs)], columns=names)
    sizes, heapify = [], clearing.heapq.heapify
    monkeypatch.setattr(clearing.heapq, "heapify", lambda q: (sizes.append(len(q)), heapify(q))[1])
    for policy in ("path_offline", "path_offline_local", "path_offline_amount"):
        sizes.clear()
        out = clearing.clear(frame, [], policy, 5)
        assert max(sizes) <= len(pairs) and sum(r[13] for r in out if r[10] == 0) == sum(range(3, 8))  # all that comes in goes out


def test_a_state_holds_only_what_a_phase_needs(six):
    """Labels, texts and dates of records are not written again with each state."""
    assert set(build_state(six, *SPAN).residuals.columns) == {"edge_id", "u", "v", "uid", "residual", "issue_index", "due_index", "issue_ordinal", "due_ordinal"}


@pytest.mark.parametrize("policy", ["path_daily_local", "path_daily_amount"])
def test_firmwise_policies_need_no_crossings(monkeypatch, policy):
    """They run over arrays and are read in parts: no object for a firm is made, and parts are cut without a loss."""
    names = ["edge_id", "u", "v", "uid", "residual", "issue_index", "due_index", "issue_ordinal", "due_ordinal"]
    rng = random.Random(3)
    rows = []
    for k in range(300):
        u, v = rng.sample(range(7), 2)
        i = rng.randrange(30)
        j = min(29, i + rng.randrange(9))
        rows.append((u * 10 + v, u, v, f"r{k}", rng.choice([5, 5, 7, 40]), i, j, i, j))
    frame = pd.DataFrame(rows, columns=names)
    whole = clearing.clear(frame, [], policy, 30)
    monkeypatch.setattr(clearing, "Crossing", None)
    monkeypatch.setattr(clearing.firmwise, "PART", 7)
    assert len(whole) > 100 and clearing.clear(frame, [], policy, 30) == whole


def test_offline_cycles_need_no_grid_of_days():
    """What an edge can carry is kept as stretches: the run doesn't hold every day of every edge, however long the horizon."""
    horizon = 10**12
    row = lambda uid, e, u, v, q, i, d: {"edge_id": e, "u": u, "v": v, "uid": uid, "residual": q, "issue_index": i, "due_index": d, "issue_ordinal": i, "due_ordinal": d}
    far = horizon - 1
    rows = [row("a", 0, 0, 1, 5, 0, far), row("b", 0, 0, 1, 4, far - 3, far), row("c", 1, 1, 0, 7, far - 5, far - 2), row("d", 2, 1, 2, 9, far - 1, far), row("e", 3, 2, 0, 3, 0, far)]
    out = clearing.clear(pd.DataFrame(rows), [((0, 1), (0, 1)), ((0, 1, 2), (0, 2, 3))], "cycle_offline", horizon)
    assert [(r[0], r[2], r[3], r[10], r[12], r[13]) for r in out] == [(0, far - 3, 7, 0, "a", 5), (0, far - 3, 7, 0, "b", 2), (0, far - 3, 7, 1, "c", 7), (1, far - 1, 2, 0, "b", 2), (1, far - 1, 2, 1, "d", 2), (1, far - 1, 2, 2, "e", 2)]


def market_frame(seed, firms, count, horizon=30):
    """Many records of few firms, with several on an edge and amounts that tie."""
    rng, rows = random.Random(seed), []
    for k in range(count):
        u, v = rng.sample(range(firms), 2)
        i = rng.randrange(horizon)
        j = min(horizon - 1, i + rng.randrange(9))
        rows.append((u * firms + v, u, v, f"r{k}", rng.choice([5, 5, 7, 40]), i, j, i, j))
    return pd.DataFrame(rows, columns=["edge_id", "u", "v", "uid", "residual", "issue_index", "due_index", "issue_ordinal", "due_ordinal"])


@pytest.mark.parametrize("policy", clearing.POLICIES)
def test_all_policies_run_over_arrays(monkeypatch, policy):
    """No object for a firm, an edge or a day is made, and the log is cut into parts without a loss."""
    frame, firms = market_frame(4, 7, 300), 7
    pairs = set(zip(frame["u"], frame["v"], strict=True))
    cycles = [((a, b, c), (a * firms + b, b * firms + c, c * firms + a)) for a, b in pairs for c in range(a + 1, firms) if a < b != c and {(b, c), (c, a)} <= pairs]
    whole = clearing.clear(frame, cycles, policy, 30)
    monkeypatch.setattr(clearing, "Market", None)
    monkeypatch.setattr(clearing, "Crossing", None)
    monkeypatch.setattr(clearing.firmwise, "PART", 7)
    monkeypatch.setattr(clearing.firmwise, "CELLS", 50)
    assert len(whole) > 100 and clearing.clear(frame, cycles[::-1], policy, 30) == whole
    assert ("path" in policy or "mixed" in policy) == any(r[1] == "path" for r in whole)


@pytest.mark.parametrize("policy", ["path_offline", "path_offline_local", "path_offline_amount"])
def test_offline_paths_keep_stretches_of_days(policy):
    """No day of an edge is made: a horizon of a billion days holds no more than one of ten."""
    row = lambda uid, e, u, v, q, i, d: {"edge_id": e, "u": u, "v": v, "uid": uid, "residual": q, "issue_index": i, "due_index": d, "issue_ordinal": i, "due_ordinal": d}
    far = 10**9 - 1
    rows = [row("a", 0, 0, 1, 5, 0, far), row("b", 0, 0, 1, 4, far - 3, far), row("c", 1, 1, 2, 7, far - 5, far - 2)]
    out = clearing.clear(pd.DataFrame(rows), [], policy, 10**9)
    assert [(r[0], r[2], r[3], r[10], r[12], r[13]) for r in out] == [(0, far - 3, 7, 0, "a", 5), (0, far - 3, 7, 0, "b", 2), (0, far - 3, 7, 1, "c", 7)]
