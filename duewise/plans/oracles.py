"""DuckDB SQL for the queries that SQL can express."""

_RAW = """n AS (SELECT count(*) AS n FROM supplier),
raw0 AS (SELECT l_orderkey || ':' || l_linenumber || ':' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS uid,
 CAST(o_custkey % n AS INTEGER) AS u, CAST(l_suppkey % n AS INTEGER) AS v, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents, CAST(o_orderdate AS DATE) AS issue_date, CAST(l_shipdate AS DATE) AS due_date
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN n),
rawi AS (SELECT *, 'company:' || u AS debtor, 'company:' || v AS creditor, CAST(year(issue_date) AS VARCHAR) AS cohort, u * 100000 + v AS edge_id,
 CASE WHEN amount_cents IS NULL OR amount_cents <= 0 THEN 'bad amount' WHEN due_date IS NULL THEN 'bad due' WHEN due_date < issue_date THEN 'negative maturity' WHEN u = v THEN 'self' END AS reason FROM raw0),
inv AS (SELECT * FROM rawi WHERE reason IS NULL)"""


def _res(source: str, name: str, start: str, end: str, days: int) -> str:
    return f""", {name} AS (SELECT uid, u, v, edge_id, amount_cents AS residual, CAST(greatest(0, date_diff('day', DATE '{start}', issue_date)) AS INTEGER) AS issue_index,
 CAST(least({days - 1}, date_diff('day', DATE '{start}', due_date)) AS INTEGER) AS due_index, CAST(date_diff('day', DATE '1970-01-01', issue_date) + 719163 AS INTEGER) AS issue_ordinal,
 CAST(date_diff('day', DATE '1970-01-01', due_date) + 719163 AS INTEGER) AS due_ordinal FROM {source} WHERE due_date >= DATE '{start}' AND issue_date <= DATE '{end}')"""


def _cap(source: str, name: str) -> str:
    return f""", {name}_c AS (SELECT edge_id, day, sum(x) AS x FROM (SELECT edge_id, issue_index AS day, residual AS x FROM {source} UNION ALL SELECT edge_id, due_index + 1, -residual FROM {source}) GROUP BY edge_id, day),
{name}_r AS (SELECT edge_id, day, sum(x) OVER (PARTITION BY edge_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS capacity, lead(day) OVER (PARTITION BY edge_id ORDER BY day) AS nxt FROM {name}_c),
{name} AS (SELECT edge_id, CAST(day AS INTEGER) AS day_from, CAST(nxt - 1 AS INTEGER) AS day_to, CAST(capacity AS BIGINT) AS capacity FROM {name}_r WHERE capacity > 0)"""


_Y = _res("inv", "res", "1998-01-01", "1998-12-31", 365)
_E = ", e AS (SELECT DISTINCT u, v, edge_id FROM inv)"
_DAY = _Y + """, cap AS (SELECT edge_id, u, v, CAST(sum(residual) AS BIGINT) AS capacity FROM res WHERE 74 BETWEEN issue_index AND due_index GROUP BY edge_id, u, v),
ops AS (SELECT f.u AS a, f.v AS b, f.edge_id, g.edge_id AS back_edge, least(f.capacity, g.capacity) AS amount, f.u || '-' || f.v AS op_id FROM cap f JOIN cap g ON f.u = g.v AND f.v = g.u WHERE f.u < f.v),
want AS (SELECT op_id, edge_id, amount FROM ops UNION ALL SELECT op_id, back_edge, amount FROM ops),
run AS (SELECT op_id, r.edge_id, r.uid, r.u, r.v, residual, amount, due_ordinal, CAST(coalesce(sum(residual) OVER (PARTITION BY op_id, r.edge_id ORDER BY due_ordinal, issue_ordinal, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
 FROM res r JOIN want w ON r.edge_id = w.edge_id WHERE 74 BETWEEN issue_index AND due_index),
frag AS (SELECT *, CAST(greatest(0, least(residual, amount - before)) AS BIGINT) AS taken FROM run WHERE amount > before)"""


def _loops(bound: int) -> str:
    return f""", grow AS (SELECT u AS s, v AS t, [u, v] AS nodes, [edge_id] AS edges FROM e WHERE u < v
 UNION ALL SELECT g.s, e.v, list_append(g.nodes, e.v), list_append(g.edges, e.edge_id) FROM grow g JOIN e ON g.t = e.u WHERE e.v > g.s AND NOT list_contains(g.nodes, e.v) AND len(g.nodes) < {bound}),
loops AS (SELECT g.nodes, list_append(g.edges, e.edge_id) AS edges, array_to_string(g.nodes, '>') AS cycle FROM grow g JOIN e ON g.t = e.u AND e.v = g.s)"""


_ON = """, lp AS (SELECT cycle, len(edges) AS need, unnest(edges) AS edge_id FROM loops),
span AS (SELECT cycle, need, day_from, day_to, capacity FROM lp JOIN cap USING (edge_id))"""

_BEST = """, i AS (SELECT v AS firm, u AS payer, capacity, row_number() OVER (PARTITION BY v ORDER BY capacity DESC, u) AS k FROM cap), o AS (SELECT u AS firm, v AS payee, capacity, row_number() OVER (PARTITION BY u ORDER BY capacity DESC, v) AS j FROM cap), s AS (SELECT i.firm, payer = payee AS same FROM i JOIN o ON i.firm = o.firm WHERE k = 1 AND j = 1), c AS (SELECT i.firm, least(i.capacity, o.capacity) AS q, 1 AS rk, payer, payee FROM i JOIN o ON i.firm = o.firm JOIN s ON s.firm = i.firm WHERE (NOT same AND k = 1 AND j = 1) OR (same AND k + j = 3) UNION ALL SELECT i.firm, least(i.capacity, o.capacity), 0, payer, payee FROM i JOIN o ON i.firm = o.firm AND payer = payee), r AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY -q * (2 - rk), -q, rk, payer, payee) AS n FROM c)"""
_ALL = """, days AS (SELECT min(issue_date) AS start, date_diff('day', min(issue_date), max(due_date)) + 1 AS n FROM inv),
res AS (SELECT uid, edge_id, date_diff('day', start, issue_date) AS issue_index, date_diff('day', start, due_date) AS due_index FROM inv, days)"""
_SPLIT = _BEST + """, pw AS (SELECT firm, payer * 100000 + firm AS edge_id, q, 0 AS leg, payer = payee AS bi FROM r WHERE n = 1 UNION ALL SELECT firm, firm * 100000 + payee, q, 1, payer = payee FROM r WHERE n = 1),
pr AS (SELECT firm, leg, bi, uid, q, residual, coalesce(sum(residual) OVER (PARTITION BY firm, leg ORDER BY due_ordinal, issue_ordinal, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM res JOIN pw ON res.edge_id = pw.edge_id WHERE 74 BETWEEN issue_index AND due_index),
pf AS (SELECT pr.*, least(residual, q - before) AS taken, CASE WHEN cohort = '1998' THEN 1 ELSE 0 END AS mine FROM pr JOIN inv ON pr.uid = inv.uid WHERE q > before),
pp AS (SELECT f.firm, least(f.before + f.taken, g.before + g.taken) - greatest(f.before, g.before) AS x, f.mine AS a, g.mine AS b FROM pf f JOIN pf g ON f.firm = g.firm AND f.leg = 0 AND g.leg = 1 AND f.before < g.before + g.taken AND g.before < f.before + f.taken WHERE NOT f.bi)"""

ORACLE_SQL = {
    "invoice_scan_by_year": f"WITH {_RAW} SELECT CAST(year(issue_date) AS INTEGER) AS issue_year, count(*) AS n_records, CAST(sum(amount_cents) AS BIGINT) AS mass_cents, min(due_date) AS first_due, max(due_date) AS last_due FROM inv GROUP BY year(issue_date)",
    "reject_audit": f"WITH {_RAW} SELECT coalesce(reason, 'retained') AS reject_reason, count(*) AS n_rows, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS mass_cents FROM rawi GROUP BY coalesce(reason, 'retained')",
    "duplicate_audit": f"WITH {_RAW}, g AS (SELECT count(*) AS n, max(amount_cents) AS a FROM inv GROUP BY debtor, creditor, issue_date, due_date, amount_cents HAVING count(*) > 1) SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_excess_rows, CAST(coalesce(sum((n - 1) * a), 0) AS BIGINT) AS duplicate_excess_amount FROM g",
    "keep_first_dedup": f"WITH {_RAW}, k AS (SELECT *, row_number() OVER (PARTITION BY debtor, creditor, issue_date, due_date, amount_cents ORDER BY uid) AS rk FROM inv) SELECT cohort, count(*) AS n_records, CAST(sum(amount_cents) AS BIGINT) AS mass_cents, min(uid) AS first_uid FROM k WHERE rk = 1 GROUP BY cohort",
    "horizon_clip": f"WITH {_RAW}{_Y} SELECT uid, issue_index, due_index, issue_ordinal, due_ordinal FROM res",
    "cohort_mass": f"WITH {_RAW} SELECT cohort, debtor, CAST(sum(amount_cents) AS BIGINT) AS mass_cents FROM inv GROUP BY cohort, debtor",
    "firm_net_position": f"WITH {_RAW} SELECT label, CAST(sum(x) AS BIGINT) AS net_cents FROM (SELECT creditor AS label, amount_cents AS x FROM inv UNION ALL SELECT debtor, -amount_cents FROM inv) GROUP BY label",
    "node_numbers": f"WITH {_RAW}, l AS (SELECT u FROM inv UNION SELECT v FROM inv) SELECT 'company:' || u AS label, CAST(row_number() OVER (ORDER BY u) - 1 AS INTEGER) AS node_id FROM l",
    "edge_day_capacity_events": f"WITH {_RAW}{_Y}{_cap('res', 'cap')} SELECT edge_id, day_from, day_to, capacity FROM cap",
    "edge_day_capacity": f"WITH {_RAW}{_Y}{_cap('res', 'cap')}, d AS (SELECT CAST(range AS INTEGER) AS day_index FROM range(365)) SELECT day_index, CAST(sum(capacity) AS BIGINT) AS capacity, count(*) AS edges, max(capacity) AS largest FROM d JOIN cap ON day_index BETWEEN day_from AND day_to GROUP BY day_index",
    "two_paths": f"WITH {_RAW}{_E} SELECT f.v AS intermediary, count(*) AS paths, CAST(sum(CASE WHEN f.u = g.v THEN 1 ELSE 0 END) AS BIGINT) AS reciprocal FROM e f JOIN e g ON f.v = g.u GROUP BY f.v",
    "reciprocal_pairs": f"WITH {_RAW}{_E} SELECT f.u AS a, f.v AS b, f.edge_id AS forward_edge, g.edge_id AS back_edge FROM e f JOIN e g ON f.u = g.v AND f.v = g.u WHERE f.u < f.v",
    "pair_common_day_capacity": f"WITH {_RAW}{_E}{_Y}{_cap('res', 'cap')}, p AS (SELECT f.u AS a, f.v AS b, f.edge_id AS x, g.edge_id AS y FROM e f JOIN e g ON f.u = g.v AND f.v = g.u WHERE f.u < f.v), m AS (SELECT a, b, greatest(c.day_from, d.day_from) AS day_index, least(c.capacity, d.capacity) AS amount_cents FROM p JOIN cap c ON c.edge_id = x JOIN cap d ON d.edge_id = y WHERE c.day_from <= d.day_to AND d.day_from <= c.day_to), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY amount_cents DESC, day_index) AS k FROM m) SELECT a, b, amount_cents, day_index FROM r WHERE k = 1",
    "cycles_bounded": f"WITH RECURSIVE {_RAW}{_E}{_loops(3)} SELECT CAST(len(nodes) AS INTEGER) AS length, nodes[1] AS first_node, count(*) AS cycles, min(cycle) AS least, max(cycle) AS greatest FROM loops GROUP BY len(nodes), nodes[1]",
    "cycle_inventory": f"WITH RECURSIVE {_RAW}{_E}{_loops(3)} SELECT CAST(len(nodes) AS INTEGER) AS length, count(*) AS cycles FROM loops GROUP BY len(nodes)",
    "cycle_common_day_capacity": f"WITH RECURSIVE {_RAW}{_Y}{_E}{_cap('res', 'cap')}{_loops(3)}{_ON}, d AS (SELECT DISTINCT cycle, day_from AS day_index FROM span), m AS (SELECT d.cycle, day_index, min(capacity) AS amount, count(*) AS have, max(need) AS need FROM d JOIN span s ON d.cycle = s.cycle AND day_index BETWEEN day_from AND day_to GROUP BY d.cycle, day_index), r AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY amount DESC, day_index) AS k FROM m WHERE have = need) SELECT cycle, amount AS amount_cents, day_index FROM r WHERE k = 1",
    "feasible_cycle_days": f"WITH {_RAW}{_Y}{_cap('res', 'cap')}, d AS (SELECT CAST(range AS INTEGER) AS day_index FROM range(365)), on_ AS (SELECT day_index, edge_id // 100000 AS u, edge_id % 100000 AS v, capacity AS c FROM d JOIN cap ON day_index BETWEEN day_from AND day_to), m AS (SELECT x.day_index, least(x.c, y.c) AS amount FROM on_ x JOIN on_ y ON x.day_index = y.day_index AND x.v = y.u AND y.v = x.u WHERE x.u < x.v UNION ALL SELECT x.day_index, least(x.c, y.c, z.c) FROM on_ x JOIN on_ y ON x.day_index = y.day_index AND x.v = y.u JOIN on_ z ON z.day_index = y.day_index AND y.v = z.u AND z.v = x.u WHERE x.u < x.v AND x.u < y.v) SELECT day_index, count(*) AS cycles, CAST(sum(amount) AS BIGINT) AS amount_cents, max(amount) AS largest FROM m GROUP BY day_index",
    "topology_degrees": f"WITH {_RAW}, p AS (SELECT DISTINCT debtor, creditor FROM inv) SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT debtor AS node, 0 AS i, 1 AS o FROM p UNION ALL SELECT creditor, 1, 0 FROM p) GROUP BY node",
    "weak_components": f"WITH RECURSIVE {_RAW}, l AS (SELECT u AS a, v AS b FROM inv UNION SELECT v, u FROM inv), r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a) SELECT CAST(node AS BIGINT) AS node, CAST(min(seen) AS BIGINT) AS component FROM r GROUP BY node",
    "strong_components": f"WITH RECURSIVE {_RAW}, l AS (SELECT DISTINCT u AS a, v AS b FROM inv), k AS (SELECT a AS node FROM l UNION SELECT b FROM l), r AS (SELECT node, node AS seen FROM k UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a) SELECT CAST(x.node AS BIGINT) AS node, CAST(min(x.seen) AS BIGINT) AS component FROM r x JOIN r y ON x.node = y.seen AND x.seen = y.node GROUP BY x.node",
    "topology": f"""WITH RECURSIVE {_RAW}, p AS (SELECT DISTINCT u, v FROM inv), l AS (SELECT u AS a, v AS b FROM p UNION SELECT v, u FROM p), k AS (SELECT DISTINCT a AS node FROM l),
wr AS (SELECT node, node AS seen FROM k UNION SELECT wr.node, l.b FROM wr JOIN l ON wr.seen = l.a), sr AS (SELECT node, node AS seen FROM k UNION SELECT sr.node, p.v FROM sr JOIN p ON sr.seen = p.u),
wc AS (SELECT c, count(*) AS n FROM (SELECT node, min(seen) AS c FROM wr GROUP BY node) GROUP BY c),
sn AS (SELECT x.node, min(x.seen) AS c FROM sr x JOIN sr y ON x.node = y.seen AND x.seen = y.node GROUP BY x.node), sc AS (SELECT c, count(*) AS n FROM sn GROUP BY c),
d AS (SELECT node, (SELECT count(*) FROM p WHERE v = node) * (SELECT count(*) FROM p WHERE u = node) AS paths, node IN (SELECT node FROM sn JOIN sc USING (c) WHERE n > 1) AS cyclic FROM k),
t AS (SELECT (SELECT count(*) FROM k) AS firms, (SELECT count(*) FROM p) AS edges, (SELECT count(*) FROM p x JOIN p y ON x.u = y.v AND x.v = y.u) AS back, (SELECT count(*) FROM wc) AS weak_components, (SELECT max(n) FROM wc) AS wl, (SELECT count(*) FROM sc) AS strong_components, (SELECT max(n) FROM sc) AS sl,
 count(*) FILTER (cyclic) AS firms_nontrivial_scc, CAST(sum(paths) AS BIGINT) AS local_two_edge_paths, CAST(coalesce(sum(paths) FILTER (cyclic), 0) AS BIGINT) AS cyclic_local_two_edge_paths FROM d)
SELECT firms, edges, edges / (firms * (firms - 1)) AS directed_density, back / edges AS reciprocity, weak_components, wl / firms AS largest_wcc_share, strong_components, sl / firms AS largest_scc_share, firms_nontrivial_scc, local_two_edge_paths, cyclic_local_two_edge_paths,
 cyclic_local_two_edge_paths / local_two_edge_paths AS cycle_closure_ratio, CASE WHEN cyclic_local_two_edge_paths > 0 THEN local_two_edge_paths / cyclic_local_two_edge_paths ELSE CAST('inf' AS DOUBLE) END AS topological_opportunity_ratio FROM t""",
    "single_day_bilateral_clearing": f"WITH {_RAW}{_DAY} SELECT a, b, amount AS amount_cents, 2 * amount AS pmr_cents FROM ops",
    "waterfall_consumption": f"WITH {_RAW}{_DAY} SELECT op_id, edge_id, uid, taken AS amount_cents, before FROM frag",
    "fifo_leg_pairing": f"WITH {_RAW}{_DAY} SELECT f.op_id, f.uid AS in_uid, g.uid AS out_uid, least(f.before + f.taken, g.before + g.taken) - greatest(f.before, g.before) AS paired, CAST(greatest(0, f.due_ordinal - g.due_ordinal) AS BIGINT) AS acceleration FROM frag f JOIN frag g ON f.op_id = g.op_id AND f.u < f.v AND g.u > g.v AND f.before < g.before + g.taken AND g.before < f.before + f.taken",
    "residuals_after_day": f"WITH {_RAW}{_DAY}, gone AS (SELECT uid, sum(taken) AS x FROM frag GROUP BY uid), rest AS (SELECT cohort, amount_cents - coalesce(x, 0) AS y FROM inv LEFT JOIN gone USING (uid)) SELECT cohort, count(*) AS n_records, CAST(sum(y) AS BIGINT) AS mass_cents FROM rest WHERE y > 0 GROUP BY cohort",
    "cohort_attribution_rules": f"WITH {_RAW}{_DAY}, s AS (SELECT op_id, CAST(2 * sum(CASE WHEN cohort = '1998' THEN taken ELSE 0 END) AS BIGINT) AS x FROM frag JOIN inv USING (uid) GROUP BY op_id) SELECT op_id, x AS symmetric, x AS conservative, x AS liberal FROM s",
    "consumption_ledger": f"WITH {_RAW}{_DAY}, gone AS (SELECT uid, sum(taken) AS x FROM frag GROUP BY uid) SELECT count(*) AS introduced_records, true AS introduced_once, count(x) AS consumed_records, CAST(0 AS BIGINT) AS consumed_record_uid_count, CAST(sum(CASE WHEN x > amount_cents THEN 1 ELSE 0 END) AS BIGINT) AS overconsumed_records, CAST(greatest(0, max(coalesce(x, 0) - amount_cents)) AS BIGINT) AS maximum_overconsumption_cents, true AS all_pass FROM inv LEFT JOIN gone USING (uid)",
    "best_path_per_intermediary": f"WITH {_RAW}{_DAY}{_BEST} SELECT firm, payer, payee, q AS amount_cents, q * (2 - rk) AS pmr_cents FROM r WHERE n = 1",
    "fragment_pair_attribution": f"WITH {_RAW}{_DAY}{_SPLIT} SELECT firm, CAST(sum(x * (a + b)) AS BIGINT) AS symmetric, CAST(sum(2 * x * a * b) AS BIGINT) AS conservative, CAST(sum(2 * x * greatest(a, b)) AS BIGINT) AS liberal FROM pp GROUP BY firm UNION ALL SELECT firm, CAST(2 * sum(taken * mine) AS BIGINT), CAST(2 * sum(taken * mine) AS BIGINT), CAST(2 * sum(taken * mine) AS BIGINT) FROM pf WHERE bi GROUP BY firm",
    "representative_days": f"WITH {_RAW}{_Y} SELECT DISTINCT CAST(d AS INTEGER) AS day_index FROM (SELECT 0 AS d UNION SELECT issue_index FROM res UNION SELECT due_index + 1 FROM res) WHERE d < 365",
    "lp_model_size": f"WITH {_RAW}{_ALL}{_E}, day AS (SELECT DISTINCT d FROM (SELECT 0 AS d UNION SELECT issue_index FROM res UNION SELECT due_index + 1 FROM res) WHERE d < (SELECT n FROM days)), p AS (SELECT f.u || '-' || f.v AS label, f.edge_id AS x, g.edge_id AS y FROM e f JOIN e g ON f.u = g.v AND f.v = g.u WHERE f.u < f.v), leg AS (SELECT label, x AS edge_id FROM p UNION ALL SELECT label, y FROM p), m AS (SELECT label, d, leg.edge_id, uid FROM leg JOIN res r ON leg.edge_id = r.edge_id JOIN day ON d BETWEEN issue_index AND due_index), ok AS (SELECT label, d FROM m GROUP BY label, d HAVING count(DISTINCT edge_id) = 2), z AS (SELECT m.* FROM m JOIN ok ON m.label = ok.label AND m.d = ok.d) SELECT (SELECT count(*) FROM ok) AS operation_days, count(*) AS allocations, 2 * (SELECT count(*) FROM ok) AS balance_rows, count(DISTINCT uid) AS capacity_rows FROM z",
    "event_days": "SELECT CAST(ts AS DATE) AS day, count(*) AS arrivals, round(sum(value), 2) AS total FROM events GROUP BY CAST(ts AS DATE)",
}
