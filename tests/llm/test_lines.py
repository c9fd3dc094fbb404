import random

import duckdb
import pytest

from duewise.llm import lines, oracles


def one_edit(a, b):
    """Edit distance of at most one, by definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def apart(x, y, units=5):
    v, w = x.split(" "), y.split(" ")
    if max(len(v), len(w)) >= units:
        return one_edit(v, w)
    return max(len(x), len(y)) >= units and one_edit(list(x), list(y))


def brute(docs):
    """Texts of ``docs`` (doc_id, text) in the order given, which is the order of the rows."""
    at = lambda r, d, k: (d is not None, d or 0, r, k)
    places = sorted((at(r, d, k), x) for r, (d, t) in enumerate(docs) for k, x in enumerate((t or "").split("\n")) if x.strip(" "))
    first = {}
    for p, x in places:
        first.setdefault(x, p)
    bad = {x for x in first if any(first[y] < first[x] and apart(x, y) for y in first)}
    gone = {p for p, x in places if x in bad or first[x] != p}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if at(r, d, k) not in gone) for r, (d, t) in enumerate(docs)]


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "é", "dd", "e.", "f", "", "g", "longer", "日本語"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 10, 14])))
    base = [line() for _ in range(30)]

    def edited():
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["zz"], [w[k], "y"], [rng.choice(words)], [w[k][1:]], [w[k] + "x"]])
            w = w or ["a"]
        return " ".join(w)

    docs = [(k, "\n".join(rng.choice([edited, line])() for _ in range(rng.randint(1, 6)))) for k in range(60)]
    same = [(7, edited() + "\n" + line()), (7, docs[7][1]), (7, docs[7][1]), (None, base[0]), (None, edited() + "\n" + base[0]), (None, base[0])]
    return [*docs, (100, None), (101, ""), (102, "\n\n"), *same, (104, "x" * 9000 + "\n" + "w " * 3000), (105, "x" * 4000 + "y" + "x" * 4999)]


def framed(spark, docs):
    rows = [(d, t, r) for r, (d, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, r int").repartitionByRange(3, "r").sortWithinPartitions("r")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    got = lines.dedup(framed(spark, docs))
    assert [r["text"] for r in sorted(got.collect(), key=lambda r: r["r"])] == brute(docs)
    assert got.agg({"n_near": "sum"}).first()[0] > 0


def test_lines_that_stand_nowhere_else_stay(spark):
    docs = [(1, "a\nb"), (7, "a\nc"), (7, "only here\nd"), (None, "q\na"), (None, "b\nq")]
    assert [r["text"] for r in sorted(lines.dedup(framed(spark, docs)).collect(), key=lambda r: r["r"])] == ["", "c", "only here\nd", "q\na", "b"]


def test_the_sql_says_the_same(spark, tmp_path):
    docs = [(d, t) for k, (d, t) in enumerate(corpus(4)) if d is not None and d not in [x for x, _ in corpus(4)[:k]]]
    framed(spark, docs).drop("r").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in lines.op6_lines(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(f"SELECT doc_id, text, n_lines, n_dropped, n_near FROM ({oracles.LINES})").fetchall())


def test_extra_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([(2, "a\nb", 1, 0), (1, "a", 2, 0), (1, "a", 2, 0)], "doc_id long, text string, n_lines int, _row int")
    got = lines.dedup(frame)
    assert got.columns == ["doc_id", "text", "n_lines", "_row", "_n_lines", "n_dropped", "n_near"]
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, ""), (1, "a"), (2, "b")]
    assert lines.dedup(frame.limit(0)).count() == 0
