import datetime as dt
import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from duewise.functions import scalars as S
from duewise.sinks import files
from duewise.sources import atomic, logs, workbook


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (S.iso_date, " 2025-01-31 ", dt.date(2025, 1, 31)), (S.iso_date, "2025-1-1", None), (S.iso_date, "2025", None), (S.iso_date, "2025-02-30", None), (S.iso_prefix, "2025-01-31T10:00", dt.date(2025, 1, 31)),
        (S.whole_cents, "+12", 12), (S.whole_cents, "0", None), (S.whole_cents, "1_000", None), (S.whole_cents, "1.5", None), (S.euros_to_cents, "1.005", 101), (S.euros_to_cents, "-1.005", -101), (S.float_cents, "0.125", 12),
        (S.float_cents, "inf", None), (S.float_cents, "x", None), (S.locale_cents, "1.234,56", 123), (S.locale_cents, "1,234.56", 123456), (S.locale_cents, "12,5", 1250), (S.locale_cents, "1,234", 123400), (S.locale_cents, "1 234,50", 123450),
        (S.locale_cents, "", None), (S.text_date, "31/01/2025 x", dt.date(2025, 1, 31)), (S.text_date, "1/31/2025", dt.date(2025, 1, 31)), (S.text_date, "3.2.2025", dt.date(2025, 2, 3)), (S.text_date, "soon", None),
        (S.excel_date, "45000.7", dt.date(2023, 3, 15)), (S.excel_date, "2025-01-02", dt.date(2025, 1, 2)), (S.fiscal_code, "X cif : RO 123 y", 123), (S.fiscal_code, None, None), (S.cell_text, "a\tb\nc", "a b c"), (S.cell_text, "12.0", "12"),
        (S.half_cents, "7/2", 7), (S.half_cents, "7", 14), (S.cancelled, " Yes", True),
    ],
)
def test_scalars(spark, make, value, want):
    assert one(spark, value, make) == want


def test_more_scalars(spark):
    row = spark.range(1).select(
        S.half_cents_text(F.lit(7)).alias("a"), S.half_cents_text(F.lit(8)).alias("b"), S.percent(F.lit(7), F.lit(7)).alias("c"), S.ordinal(F.lit("2025-01-01").cast("date")).alias("d"), S.leap_february_end(F.lit(2024)).alias("e"),
        S.canonical_rotation(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("f"), S.word_days(S.day_words(F.array(*map(F.lit, [0, 5, 63, 64, 200])))).alias("g"), S.fingerprint(F.lit("a"), F.lit(None).cast("string")).alias("h"),
    ).first()
    import hashlib

    assert row["a"] == "7/2" and row["b"] == "4" and row["c"] == 50.0 and row["d"] == dt.date(2025, 1, 1).toordinal() and row["e"] == dt.date(2024, 2, 29)
    assert row["f"] == [1, 2, 3] and row["g"] == [0, 5, 63, 64, 200] and row["h"] == hashlib.sha256(b"a\x1f").hexdigest()


def test_firm_order(spark):
    labels = ["x", "company:10", "company:9", "other:9", "cif:9", "company:A", "company:é"]
    frame = spark.createDataFrame([(x,) for x in labels], "label string")
    key = lambda t: (int(t.split(":")[1]) if ":" in t and t.split(":")[1].isdigit() else 0, 0 if t.split(":")[0] in ("cif", "company") and ":" in t else 1, t)
    assert [r["label"] for r in frame.orderBy(*S.node_key(F.col("label"))).collect()] == sorted(labels, key=key)


HEAD = "uid,debtor,creditor,amount_cents,issue_date,due_date,extra\n"


def test_csv_round_trip_with_gzip_and_mark(spark, tmp_path):
    text = "﻿" + HEAD + 'r1," A ""x"" ","B, C",100,2025-01-01,2025-01-02,zz\n'
    with gzip.open(f"{tmp_path}/a.csv.gz", "wt", encoding="utf-8") as f:
        f.write(text)
    records = atomic.load_atomic_csv(spark, f"{tmp_path}/a.csv.gz")
    row = records.first()
    assert (row["debtor"], row["creditor"], row["amount_cents"], row["status"]) == ('A "x"', "B, C", 100, "")
    files.write_atomic_csv(records, f"{tmp_path}/out", gzip=True, one_file=True)
    assert atomic.load_atomic_csv(spark, f"{tmp_path}/out").collect() == [row]
    assert atomic.default_cohort(records).first()["cohort"] == "2025"


@pytest.mark.parametrize(
    ("line", "why"),
    [
        ("r1,A,A,1,2025-01-01,2025-01-02,", "self"), ("r1,A,B,0,2025-01-01,2025-01-02,", "amount"), ("r1,A,B,1,2025-01-03,2025-01-02,", "due before"), (",A,B,1,2025-01-01,2025-01-02,", "uid"), ("r1,,B,1,2025-01-01,2025-01-02,", "party"),
        ("r1,A,B,1,x,2025-01-02,", "issue date"), ("r1,A,B,1,2025-01-01,2025-01-02,\nr1,A,B,1,2025-01-01,2025-01-02,", "duplicate"), ("", "no records"),
    ],
)
def test_bad_records_are_refused(spark, tmp_path, line, why):
    (tmp_path / "a.csv").write_text(HEAD + line + "\n")
    with pytest.raises(atomic.RecordError, match=why):
        atomic.load_atomic_csv(spark, f"{tmp_path}/a.csv")


def test_missing_columns_and_manifests(spark, tmp_path):
    (tmp_path / "a.csv").write_text("uid,debtor\nx,y\n")
    with pytest.raises(atomic.RecordError, match="missing columns"):
        atomic.load_atomic_csv(spark, f"{tmp_path}/a.csv")
    (tmp_path / "m.csv").write_text("cohort,input_csv,issue_start_date,issue_end_date\n2025,a.csv,2025-01-01,2025-12-31\n")
    assert atomic.read_manifest(spark, f"{tmp_path}/m.csv", atomic.ANNUAL_MANIFEST)[0]["cohort"] == "2025"


def export_line(**k):
    row = [""] * 16
    for n, v in ({"_0": "7", "_5": "c", "_6": "d", "_7": "s", "_8": "1", "_9": "10,50", "_11": "Y", "_12": "y", "_13": "01/02/2022", "_14": "01/03/2022", "_15": "0"} | k).items():
        row[int(n[1:])] = v
    return ";".join(row)


def test_positional_export_rejects_in_order(spark, tmp_path):
    lines = [export_line(), export_line(), export_line(_9="0", _14="x"), export_line(_14="x"), export_line(_14="01/01/2022"), export_line(_15="1", _6=""), export_line(_6=""), export_line(_6="c"), export_line(_11="N"), "short;row", export_line(_13="01/01/2023")]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    raw = atomic.read_positional(spark, f"{tmp_path}/a.csv")
    cross = spark.createDataFrame([("c", 99)], "internal_id string, cif bigint")
    rows = atomic.database_half(raw, "2022-01-01", "2022-06-30", crosswalk=cross, validated_only=True, deduplicate=True)
    got = {r["reject_reason"]: r["n_rows"] for r in atomic.load_audit(rows).collect()}
    assert got == {"retained": 1, "duplicate": 1, "bad amount": 1, "bad due": 1, "negative maturity": 1, "cancelled": 1, "bad party": 1, "self": 1, "validation": 1}
    kept = atomic.accepted(rows).first()
    assert kept["creditor"] == "cif:99" and kept["debtor"] == "db:d" and kept["uid"] == "db:000000000007:000000001" and kept["amount_cents"] == 1050
    assert atomic.duplicate_audit(rows).first()["duplicate_excess_rows"] == 1


def test_harmonised_sources(spark):
    names = "row_id source_file supplier_code buyer_code series number issue due value supplier_validation buyer_validation canceled invoice_status quality_flag".split()
    base = dict(zip(names, ["1", "Database 2020", "s", "b", "x", "1", "2020-05-01", "2020-06-01", "1.25", "Y", "Y", "", "validata", ""], strict=True))
    rows = [base, base | {"row_id": "2"}, base | {"quality_flag": atomic.KNOWN_COPIES[0], "value": "x"}, base | {"canceled": "YES"}, base | {"issue": "2021-01-01"}, base | {"buyer_validation": "N"}]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    got = {r["reject_reason"]: r["n_rows"] for r in atomic.load_audit(atomic.harmonised_year(frame, 2020, validated_only=True, deduplicate=True)).collect()}
    assert got == {"retained": 1, "duplicate": 1, "known copy": 1, "cancelled": 1, "validation": 1}
    buffer = {r["reject_reason"]: r["n_rows"] for r in atomic.load_audit(atomic.harmonised_buffer(frame, "2020-01-01", "2020-12-31")).collect()}
    assert buffer == {"retained": 4, "bad amount": 1, "outside": 1}


def book(path, rows):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Summary" r:id="a"/><sheet name="Data" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')


def test_workbooks_and_crosswalk(spark, tmp_path):
    head = ["Valoare", "Client", "Furnizor", "Data", "Data Scadenta", "Stare", "Serie", "Numar"]
    book(f"{tmp_path}/a.xlsx", [head, ["10.5", "CIF: RO 11", "CIF: 22", "44743", "44774", "Validata", "s", "1"], ["", "", "", "", "", "", "", ""], ["x", "CIF:1", "CIF:2", "44743", "44774", "", "", ""], ["1", "CIF:1", "CIF:1", "44743", "44774", "", "", ""]])
    rows = workbook.with_columns(workbook.read_workbooks(spark, f"{tmp_path}/*.xlsx"), head)
    found = atomic.workbook_half(rows, "2022-07-01", "2022-12-31")
    assert {r["reject_reason"]: r["n_rows"] for r in atomic.load_audit(found).collect()} == {"retained": 1, "bad amount": 1, "self": 1}
    kept = atomic.accepted(found).first()
    assert (kept["debtor"], kept["creditor"], kept["amount_cents"], kept["uid"]) == ("cif:11", "cif:22", 1050, "xlsx:a.xlsx:Data:000000002")
    workbook.register(spark)
    assert spark.read.format("workbook").load(str(tmp_path)).count() == 3
    (tmp_path / "e.csv").write_text(export_line(_9="10,5", _13="01/07/2022", _14="01/08/2022") + "\n")
    cross = {r["internal_id"]: r["cif"] for r in atomic.crosswalk(rows, atomic.read_positional(spark, f"{tmp_path}/e.csv"), "2022-07-01", "2022-07-08").collect()}
    assert cross == {"d": 11, "c": 22}


def test_curves_and_digests(spark, tmp_path):
    (tmp_path / "c.csv").write_text("date,cycle_cohort_pmr_cents,path_cohort_pmr_cents\n2025-01-01,3,7/2\n")
    row = logs.read_curve(spark, f"{tmp_path}/c.csv").first()
    assert (row["cycle"], row["path"]) == (6, 7)
    import hashlib

    want = hashlib.sha256((tmp_path / "c.csv").read_bytes()).hexdigest()
    logs.demand_digests(spark, {f"{tmp_path}/c.csv": want})
    with pytest.raises(atomic.RecordError):
        logs.demand_digests(spark, {f"{tmp_path}/c.csv": "0"})
