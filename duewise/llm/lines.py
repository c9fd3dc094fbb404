"""Line dedup by a deletion-neighbourhood join; DataFrame functions only.

A line is dropped if the same line, or one within the edit bound, stands earlier in the corpus. The bound is one edit (a unit
replaced, added or left out) in lines of at least ``units`` units, so that with 5 four fifths stay equal. Units are words; where
both lines have fewer than ``units`` words, they are characters. So every line is compared at the finest unit that the bound
allows, and only lines of fewer than ``units`` characters, of which an edit would change more, must be equal. Blank lines stay.

Rows are told apart by a number of their own, not by doc_id: earlier means by doc_id (nulls first), then by row, then by place.

1. Each line becomes two hashes and its anchors, first and last halves. Two lines within one edit of each other share the half
   where they don't differ, so only lines with a half that some different line shares go on (none is lost).
2. Those lines emit all variants within the bound as hashed keys: for each unit of the other half, the line without it, once
   with its place (lines that differ in one unit meet there) and once without (the line with one unit less, which emits itself,
   meets it). Keys that two different lines have are found first, by an aggregation of hashes alone.
3. Equal variants are joined. In a group of the first kind any two lines are one replacement apart, so its earliest line
   answers for all others: no pairs within a group. A key of the second kind is one shorter line's and its longer lines'.
4. Each pair found is verified by its edit distance, and each line keeps the earliest partner.

Scale: rows are written once with their numbers; groups are aggregated before shuffling, joins on hot keys can be split, and
texts are shuffled once, by row, to take the lines out. Small side tables are broadcast after counting them; otherwise the
join shuffles.

Edge cases: null texts stay null, empty texts empty; rows that share a doc_id or have none are rows of their own, so of rows
alike in everything the first stays whole; an empty table gives an empty result; other columns are carried along, and the
columns added take other names if theirs are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm.common import fresh, small, table, written

UNITS = 5
WORD, CHARACTER = 0, 1


def occurrences(rows: DataFrame, text: str = "text") -> DataFrame:
    """(doc, row, pos, line) of every line that isn't blank. ``rows``: _row, doc_id and ``text``."""
    return rows.select(F.col("doc_id").cast("long").alias("doc"), F.col("_row").alias("row"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line")).filter(F.trim("line") != "")


def hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")]


def words_in(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def head(line: Column, kind: Column | int, k: Column) -> Column:
    """The first ``k`` units of a line."""
    words = F.call_function("substring_index", line, F.lit(" "), k)
    letters = F.substr(line, F.lit(1), k)
    return (words if kind == WORD else letters) if isinstance(kind, int) else F.when(kind == WORD, words).otherwise(letters)


def tail(line: Column, kind: Column | int, k: Column) -> Column:
    """The last ``k`` units of a line."""
    words = F.call_function("substring_index", line, F.lit(" "), -k)
    letters = F.right(line, k)
    return (words if kind == WORD else letters) if isinstance(kind, int) else F.when(kind == WORD, words).otherwise(letters)


def anchors(line: Column, words: Column, units: int) -> Column:
    """Hashes of the first and last halves of a line, cut as for its number of units and for one less; the last bit says which half.

    Lines of ``units - 1`` words and more are cut by words, those of fewer than ``units`` by characters (some by both).
    """

    def half(kind: int, m: Column, last: int) -> Column:
        p = F.floor(m / 2).cast("int")
        part = tail(line, kind, m - p) if last else head(line, kind, p)
        return F.shiftleft(F.shiftright(F.xxhash64(F.lit(2 * kind + last), m, part), 1), 1) + F.lit(last)

    def halves(kind: int, n: Column) -> Column:
        return F.array(half(kind, n, 0), half(kind, n, 1), half(kind, n - 1, 0), half(kind, n - 1, 1))

    none, n, letters = F.array().cast("array<bigint>"), words.cast("int"), F.length(line)
    by_words = F.when(n >= units - 1, halves(WORD, n)).otherwise(none)
    return F.when(n >= units, halves(WORD, n)).otherwise(F.concat(by_words, F.when(letters >= units - 1, halves(CHARACTER, letters)).otherwise(none)))


def variants(lines: DataFrame, units: int) -> DataFrame:
    """(key, role) of each line's variants: 0 without a unit, at its place; 1 without a unit; 2 as it is.

    Units of the first half are left out where the last half is shared (``last``), and the other way round (``first``).
    """
    n = words_in(F.col("line"))
    kinds = F.when(n >= units, F.array(F.lit(WORD))).when(n == units - 1, F.array(F.lit(WORD), F.lit(CHARACTER))).otherwise(F.array(F.lit(CHARACTER)))
    each = lines.withColumn("kind", F.explode(kinds)).withColumn("n", F.when(F.col("kind") == WORD, words_in(F.col("line"))).otherwise(F.length("line")).cast("int"))
    line, kind, n = F.col("line"), F.col("kind"), F.col("n")
    gone = lambda i: (F.col("last") & (i <= F.floor(n / 2))) | (F.col("first") & (i >= F.floor((n - 1) / 2)))

    def without(i: Column) -> Column:
        gap = F.when((kind == WORD) & (i > 0) & (i < n - 1), " ").otherwise("")
        return F.concat(head(line, kind, i), gap, tail(line, kind, n - 1 - i))

    places = F.filter(F.sequence(F.lit(0), n - 1), gone)
    less = F.transform(places, lambda i: F.struct(i.alias("i"), without(i).alias("x")))
    each = each.withColumn("less", F.when(n >= units, less).otherwise(F.array().cast("array<struct<i:int,x:string>>")))
    tag = lambda key, role: F.struct(key.alias("key"), F.lit(role).cast("byte").alias("role"))
    at = F.transform("less", lambda v: tag(F.xxhash64(F.lit(0), kind, n, v["i"], v["x"]), 0))
    alone = F.array_distinct(F.transform("less", lambda v: tag(F.xxhash64(F.lit(1), kind, v["x"]), 1)))
    whole = F.array(tag(F.xxhash64(F.lit(1), kind, line), 2))
    return each.select("doc", "row", "pos", "h1", "h2", F.explode(F.concat(at, alone, whole)).alias("v")).select("doc", "row", "pos", "h1", "h2", "v.key", "v.role")


def one_apart(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one replaced, added or missing word apart."""
    n, m = F.size(a), F.size(b)
    differ = F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True)))
    at = F.array_position(differ, True).cast("int")  # the first place where they differ
    rest = lambda w, k: F.slice(w, k, F.greatest(F.size(w), F.lit(1)))
    return F.when(at == 0, n == m).when(n == m, rest(a, at + 1) == rest(b, at + 1)).when(n == m + 1, rest(a, at + 1) == rest(b, at)).when(m == n + 1, rest(a, at) == rest(b, at + 1)).otherwise(False)


def within_bound(a: Column, b: Column, units: int) -> Column:
    """Whether two lines are within the edit bound."""
    by_words = F.greatest(words_in(a), words_in(b)) >= units
    letters = (F.greatest(F.length(a), F.length(b)) >= units) & (F.levenshtein(a, b, 1) >= 0)
    return F.when(by_words, one_apart(F.split(a, " "), F.split(b, " "))).otherwise(letters)


def near(rows: DataFrame, occ: DataFrame, units: int, text: str = "text") -> DataFrame:
    """(h1, h2, kept) of lines that have an earlier line within the bound: kept is the earliest such line's (doc, row, pos)."""
    keys = occ.select("h1", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("anchor")
    keys = written(keys)
    chosen = occ.select("h1", "h2", "doc", "row", "pos", F.explode("anchors").alias("anchor")).join(small(keys, keys.count()), "anchor", "left_semi")
    side = F.pmod(F.col("anchor"), F.lit(2)) == 1
    chosen = chosen.groupBy("h1", "h2").agg(F.min(F.struct("doc", "row", "pos")).alias("at"), F.max(~side).alias("first"), F.max(side).alias("last"))
    chosen = written(chosen.select(F.col("at.row").alias("row"), F.col("at.pos").alias("pos"), "first", "last"))
    said = occurrences(rows, text).join(small(chosen, chosen.count()), ["row", "pos"])
    lines = written(said.select("doc", "row", "pos", *hashes(), "line", "first", "last"))
    own = F.struct("doc", "row", "pos", "h1", "h2")
    every = variants(lines, units)
    keys = written(every.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("key"))
    met = written(every.join(small(keys, keys.count()), "key", "left_semi"))
    at = met.filter("role = 0").select("key", own.alias("x"))
    groups = at.groupBy("key").agg(F.min("x").alias("kept"))
    same_length = at.join(groups, "key").filter((F.col("kept.h1") != F.col("x.h1")) | (F.col("kept.h2") != F.col("x.h2"))).select("x", "kept")
    pairs = met.filter("role = 1").select("key", own.alias("long")).join(met.filter("role = 2").select("key", own.alias("short")), "key")
    other_length = pairs.select(F.greatest("long", "short").alias("x"), F.least("long", "short").alias("kept"))
    found = written(same_length.unionByName(other_length).select("x.h1", "x.h2", "kept").distinct())
    mine, theirs = lines.select("h1", "h2", F.col("line").alias("a")), lines.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("line").alias("b"))
    right = found.join(mine, ["h1", "h2"]).join(theirs, (F.col("kept.h1") == F.col("k1")) & (F.col("kept.h2") == F.col("k2"))).filter(within_bound(F.col("a"), F.col("b"), units))
    return right.groupBy("h1", "h2").agg(F.min("kept").alias("kept")).select("h1", "h2", F.struct("kept.doc", "kept.row", "kept.pos").alias("kept"))


def dropped(rows: DataFrame, *, units: int = UNITS, text: str = "text") -> DataFrame:
    """(row, pos, kept_doc, kept_row, kept_pos, near) of each line to drop and the earlier line that stands for it.

    ``rows`` have a number ``_row`` of their own, the same whenever they are read.
    """
    lines = occurrences(rows, text).withColumn("n", words_in(F.col("line")))  # a column, so that it is counted once a line
    occ = written(lines.select("doc", "row", "pos", *hashes(), anchors(F.col("line"), F.col("n"), units).alias("anchors")))
    own = F.struct("doc", "row", "pos")
    first = occ.groupBy("h1", "h2").agg(F.min(own).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "kept")
    bad = first.withColumn("near", F.lit(False)).unionByName(near(rows, occ, units, text).withColumn("near", F.lit(True)))
    bad = written(bad.groupBy("h1", "h2").agg(F.max(F.struct("near", "kept")).alias("x")).select("h1", "h2", "x.kept", "x.near"))
    gone = occ.select("doc", "row", "pos", "h1", "h2").join(small(bad, bad.count()), ["h1", "h2"])
    gone = gone.filter(F.col("near") | (F.col("row") != F.col("kept.row")) | (F.col("pos") != F.col("kept.pos")))
    return gone.select("row", "pos", F.col("kept.doc").alias("kept_doc"), F.col("kept.row").alias("kept_row"), F.col("kept.pos").alias("kept_pos"), "near")


def dedup(docs: DataFrame, *, units: int = UNITS, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` less its dropped lines, and n_lines, n_dropped, n_near (whole lines, dropped, of these near ones)."""
    names = [fresh(x, docs.columns) for x in ("n_lines", "n_dropped", "n_near")]
    rows = written(docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], F.monotonically_increasing_id().alias("_row")))
    t, d = (next(F.col(f"c{k}") for k, c in enumerate(docs.columns) if c.lower() == name.lower()) for name in (text, "doc_id"))
    gone = dropped(rows.select("_row", d.alias("doc_id"), t.alias("text")), units=units)
    gone = gone.groupBy(F.col("row").alias("_row")).agg(F.collect_list("pos").alias("_gone"), F.count_if("near").alias("_near"))
    out = rows.join(gone, "_row", "left").withColumn("_lines", F.split(t, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    left = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    kept = F.when(F.col("_gone").isNull(), t).otherwise(left)
    return out.select(
        *[(kept if c.lower() == text.lower() else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)],
        F.when(t.isNull(), 0).otherwise(F.size("_lines")).alias(names[0]),
        F.coalesce(F.size("_gone"), F.lit(0)).alias(names[1]),
        F.coalesce("_near", F.lit(0)).cast("int").alias(names[2]),
    )


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text less repeated lines, and counts of lines."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
