"""Column expressions: dates, amounts, labels, hashes, halves of cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDINAL_OF_EPOCH = 719_163


def stripped(c: Column) -> Column:
    """Without blanks of any kind at either end; null counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")


def iso_date(c: Column) -> Column:
    """A date written YYYY-MM-DD, else null."""
    s = stripped(c)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date"))


def iso_prefix(c: Column) -> Column:
    """A date from the first ten characters, else null."""
    return iso_date(F.substring(stripped(c), 1, 10))


def whole_cents(c: Column) -> Column:
    """A positive whole number of cents, else null."""
    s = stripped(c)
    n = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))
    return F.when(n > 0, n)


def euros_to_cents(c: Column) -> Column:
    """Decimal euros to cents, halves away from zero."""
    return F.round(c.try_cast("decimal(38,10)") * 100, 0).cast("bigint")


def float_cents(c: Column) -> Column:
    """A number read as double, times 100, halves to even; null if it isn't finite."""
    x = stripped(c).try_cast("double")
    return F.when(F.abs(x) < float("inf"), F.rint(x * 100).try_cast("bigint"))


def locale_cents(c: Column) -> Column:
    """An amount with commas or points: with both, commas group; a lone comma before one or two digits is the decimal mark."""
    s = F.regexp_replace(stripped(c), r"[\x{A0} ]", "")
    decimal = s.rlike(r"^[^,]*,[^,]{0,2}$") & ~s.contains(".")
    return float_cents(F.when(decimal, F.regexp_replace(s, ",", ".")).otherwise(F.regexp_replace(s, ",", "")))


def text_date(c: Column) -> Column:
    """The first word as d/m/y, m/d/y, y-m-d or d.m.y, tried in this order; else null."""
    token = F.split(stripped(c), r"\s+").getItem(0)
    shape = {"d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$"}
    return F.coalesce(*[F.when(token.rlike(r), F.try_to_timestamp(token, F.lit(f))) for f, r in shape.items()]).cast("date")


def excel_date(c: Column) -> Column:
    """A spreadsheet's serial day over 1000, else a date as text."""
    serial = F.regexp_replace(stripped(c), ",", "").try_cast("double")
    return F.when(serial > 1000, F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))).otherwise(text_date(c))


def fiscal_code(c: Column) -> Column:
    """The number after ``CIF:``, else null."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)CIF\s*:\s*(?:RO\s*)?([0-9]+)", 1).try_cast("bigint")


def fingerprint(*parts: Column, null: str = "") -> Column:
    """SHA-256 over the parts, joined by unit separators."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit(null)) for p in parts]), 256)


def ordinal(d: Column) -> Column:
    """Days since the year 1 began, counted from 1."""
    return (F.unix_date(d) + ORDINAL_OF_EPOCH).cast("int")


def day_index(d: Column, start: Column) -> Column:
    return F.datediff(d, start)


def node_key(label: Column) -> list[Column]:
    """Order of firms: number after the first colon, then fiscal or company labels (what stands before the colon, or all) before others, then the label."""
    tail = F.when(label.contains(":"), F.regexp_extract(label, r"^[^:]*:(.*)$", 1))
    number = F.when(tail.rlike(r"^\d+$"), tail.try_cast("decimal(38,0)"))
    space = F.substring_index(label, ":", 1)
    return [F.coalesce(number, F.lit(0)), F.when(space.isin("cif", "company"), 0).otherwise(1), label]


def leap_february_end(year: Column) -> Column:
    return F.last_day(F.make_date(year, F.lit(2), F.lit(1)))


def half_cents_text(half: Column) -> Column:
    """Halves of cents as ``n`` or ``n/2``."""
    return F.when(half % 2 == 0, (half / 2).cast("bigint").cast("string")).otherwise(F.concat(half.cast("string"), F.lit("/2")))


def half_cents(text: Column) -> Column:
    """The same read back."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, parts[0].cast("bigint") * (F.lit(2) / parts.getItem(1).cast("bigint")).cast("bigint")).otherwise(parts[0].cast("bigint") * 2)


def percent(half: Column, mass: Column) -> Column:
    return F.when(mass != 0, half / 2 / mass * 100)


def cancelled(c: Column) -> Column:
    return F.lower(stripped(c)).isin("1", "y", "yes", "true")


def validated(source: Column, supplier: Column, buyer: Column, status: Column) -> Column:
    """Both parties agreed, in database extracts; else the status says so."""
    both = (F.upper(stripped(supplier)) == "Y") & (F.upper(stripped(buyer)) == "Y")
    return F.when(F.lower(F.coalesce(source, F.lit(""))).contains("database"), both).otherwise(F.lower(stripped(status)) == "validata")


def cell_text(c: Column) -> Column:
    """A cell on one line: tabs and line ends become blanks, whole floats lose their point."""
    s = F.translate(F.coalesce(c, F.lit("")), "\t\r\n", "   ")
    return F.when(s.rlike(r"^-?\d+\.0+$"), F.regexp_replace(s, r"\.0+$", "")).otherwise(s)


def match_key(issue: Column, due: Column, amount: Column, series: Column, number: Column) -> Column:
    return F.struct(issue.alias("issue"), due.alias("due"), amount.alias("amount"), F.upper(stripped(series)).alias("series"), stripped(number).alias("number"))


def canonical_rotation(nodes: Column) -> Column:
    """A cycle's nodes turned so that the smallest comes first."""
    k = F.array_position(nodes, F.array_min(nodes)).cast("int")
    return F.concat(F.slice(nodes, k, F.size(nodes)), F.slice(nodes, 1, k - 1))


def day_words(days: Column) -> Column:
    """Day indexes as an array of 64-bit words."""
    words = F.sequence(F.lit(0), F.floor(F.coalesce(F.array_max(days), F.lit(0)) / 64).cast("int"))
    bit = lambda d: F.call_function("shiftleft", F.lit(1).cast("bigint"), (d % 64).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.filter(days, lambda d: F.floor(d / 64).cast("int") == w), F.lit(0).cast("bigint"), lambda a, d: a.bitwiseOR(bit(d))))


def stretch_words(stretches: Column) -> Column:
    """Stretches of days (``day_from`` to ``day_to``, an array of structs) as an array of 64-bit words; no day is made."""
    last = F.array_max(F.transform(stretches, lambda s: s["day_to"]))
    words = F.sequence(F.lit(0), F.floor(F.coalesce(last, F.lit(0)) / 64).cast("int"))
    ones = lambda n: F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (F.lit(64) - n).cast("int"))  # noqa: E731  (n from 1 to 64)

    def bits(s, w):
        low, high = F.greatest(s["day_from"], w * 64), F.least(s["day_to"], w * 64 + 63)
        return F.when(low <= high, F.call_function("shiftleft", ones(high - low + 1), (low - w * 64).cast("int"))).otherwise(F.lit(0).cast("bigint"))

    return F.transform(words, lambda w: F.aggregate(stretches, F.lit(0).cast("bigint"), lambda a, s: a.bitwiseOR(bits(s, w))))


def word_days(words: Column) -> Column:
    """The day indexes of an array of 64-bit words, in order."""
    one = lambda w, k: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftrightunsigned", w, b).bitwiseAND(F.lit(1)) == 1)
    return F.flatten(F.transform(words, lambda w, k: F.transform(one(w, k), lambda b: b + k * 64)))


def topology_line(debtor: Column, creditor: Column) -> Column:
    return F.concat(debtor, F.lit("\x1f"), creditor, F.lit("\n"))
