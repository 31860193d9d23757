"""Delimited exports from files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ghgspark.operators import profile
from ghgspark.operators.enrich import build_records
from ghgspark.operators.tabular import Export
from ghgspark.sources.factors import default_factors
from ghgspark.sources.lines import read_lines

ESSEN = """Werk;Zeitraum;Energieart;Verbrauch;Einheit;Kosten;Waehrung;Zaehler_ID;Bemerkung
Essen Blending;2024-01;Strom;478800,0;kWh;116461,40;EUR;DE-ESS-001;Hauptzähler Produktion
;;;;;;;;
Essen Blending;2024-01;Erdgas;310800,0;kWh;24864,00;EUR;DE-ESS-G01;Kessel + Trockner

Essen Blending;2024-02;Diesel;8500,0;Liter;13600,00;EUR;;Interne Logistik
Essen Blending;2024-03
"Essen ""B"";x";2024-03;Strom;420000,0;kWh;n/a;EUR;DE-ESS-001;Hauptzähler – Produktion
"""


@pytest.fixture(scope="module")
def export(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    (folder / "essen.csv").write_bytes(ESSEN.replace("\n", "\r\n").encode("cp1252"))
    (folder / "headerless.csv").write_text(
        "Essen Blending;2024-01;Strom;478800,0;kWh;116461,40;EUR\nEssen Blending;2024-02;Erdgas;285000,0;kWh;22800,00;EUR\n")
    (folder / "bom.csv").write_bytes(
        b"\xef\xbb\xbfWerk;Zeitraum;Energieart;Verbrauch;Einheit;Kosten;Waehrung\n"
        b"Essen Blending;2024-01;Strom;478800.0;kWh;116461.40;EUR\n")
    (folder / "empty.csv").write_text("")
    (folder / "blank.csv").write_text("  \n\n")
    (folder / "header_only.csv").write_text("Werk;Zeitraum;Energieart\n")
    (folder / "junk.csv").write_text("a;b\nc;d\n")
    (folder / "latin.csv").write_bytes("Werk;Monat;Menge\nK\x81ln \xe4;2024-01;1,0\n".encode("latin-1"))
    (folder / "comma.csv").write_text(
        'site,period,energy_type,amount,unit,cost\n"A, B",Januar 2024,electricity,"1,234.50",MWh,12.5\nA,2024-02,gas,10.5,m3,x\n')
    return Export(read_lines(spark, str(folder)))


def test_profiles(export):
    files = {r["file"]: r for r in export.files.collect()}
    assert set(files) == {"essen.csv", "headerless.csv", "bom.csv", "header_only.csv", "junk.csv", "latin.csv", "comma.csv"}
    assert {f: r["encoding"] for f, r in files.items() if r["encoding"] != "utf-8-sig"} == {
        "essen.csv": "cp1252", "latin.csv": "iso-8859-1"}
    assert files["comma.csv"]["delimiter"] == ","
    assert files["bom.csv"]["number_format"] == "english"
    assert files["headerless.csv"]["has_header"] is False
    assert files["headerless.csv"]["columns"].asDict() == {
        "site": 0, "period": 1, "energy_type": 2, "energy_amount": 3, "unit": 4, "total_eur": 5,
        "currency": None, "meter_id": None, "cost_center": None, "remarks": None}


def test_rows(export):
    rows = {(r["filename"], r["row_number"]): r for r in export.documents().collect()}
    assert sorted(n for f, n in rows if f == "essen.csv") == [1, 2, 3, 5]
    first = rows["essen.csv", 1]
    assert (first["site_address"], first["total_amount"], first["invoice_number"]) == (
        "Essen Blending", 116461.40, "SAP-essen-R1")
    assert first["row_hash"] == hashlib.sha256(b"essen.csv:row_1").hexdigest()
    assert rows["essen.csv", 3]["line_items"][0]["consumption_unit"] == "Liter"
    assert rows["essen.csv", 5]["site_address"] == 'Essen "B";x'
    assert rows["essen.csv", 5]["warnings"] == ["Could not parse cost: 'n/a'"]
    assert rows["essen.csv", 5]["raw_text"].endswith("Hauptzähler – Produktion")
    assert rows["comma.csv", 1]["site_address"] == "A, B"
    assert rows["comma.csv", 1]["line_items"][0]["consumption_kwh"] == 1234500.0
    assert rows["comma.csv", 2]["line_items"][0]["consumption_kwh"] == pytest.approx(110.775)
    assert rows["latin.csv", 1]["site_address"] == "K\x81ln ä"


def test_failures_and_skips(export):
    assert [tuple(r) for r in export.file_errors().collect()] == [
        ("junk.csv", "Cannot infer column mapping for junk.csv (fewer than 3 columns identifiable)")]
    assert {r[0]: r[1] for r in export.skipped_rows().collect()}["essen.csv"] == 1


def test_line_order_does_not_matter(spark, export):
    shuffled = Export(export.lines.repartition(7, F.rand(3)))
    columns = ["blob_name", "raw_text", "row_hash"]
    assert sorted(shuffled.documents().select(columns).collect()) == sorted(export.documents().select(columns).collect())


def test_rows_are_numbered_across_blocks(spark):
    lines = [("big.csv", 0, -1, "Werk;Monat;Menge")]
    lines += [("big.csv", n // 10, n, f"S{n};2024-01;{n},5" if n % 7 else ";;") for n in range(1, 400)]
    frame = spark.createDataFrame(lines, "file string, block bigint, pos bigint, value string").repartition(5)
    kept = [n for n in range(1, 400) if n % 7]
    found = {r["site_address"]: r["row_number"] for r in Export(frame).documents().collect()}
    assert found == {f"S{n}": i for i, n in enumerate(kept, start=1)}


def test_delimiter_sample_ends_at_4096_characters(spark):
    # The third line starts beyond the sample, so its commas are not counted.
    lines = [("f.csv", 0, 0, "Werk;Monat;Menge;" + "x" * 4200), ("f.csv", 0, 1, "a,b,c"), ("f.csv", 0, 2, "a;2024-01;1,0;")]
    frame = spark.createDataFrame(lines, "file string, block bigint, pos bigint, value string")
    assert Export(frame).files.first()["delimiter"] == ";"


def test_quoting(spark):
    cases = ['a;b', '"a;b";c', '"a""b";;', 'x"y;z', ';a', '', '"open;end']
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").orderBy("i")
    found = [r[0] for r in frame.select(profile.split_cells(F.col("t"), F.lit(";"))).collect()]
    assert found == [["a", "b"], ["a;b", "c"], ['a"b', "", ""], ['x"y', "z"], ["", "a"], [""], ["open;end"]]


def test_records(spark, export):
    records = {r["invoice_number"]: r for r in build_records(export.documents(), default_factors(spark)).collect()}
    assert records["SAP-essen-R1"]["emissions_tco2"] == pytest.approx(181.944)
    assert records["SAP-essen-R3"]["emissions_tco2"] == pytest.approx(22.780)
    assert records["SAP-essen-R1"]["pdf_hash"] == hashlib.sha256(b"essen.csv:row_1").hexdigest()


def test_whole_files_decide(spark, tmp_path):
    """The first row and the first lines mislead: only all rows tell delimiter and number format."""
    (tmp_path / "late.csv").write_text(
        "Werk;Zeitraum;Energieart;Verbrauch;Einheit;Kosten\nA, B, C, D, E, F, G;2024-01;Strom;;kWh;\n"
        + "".join(f"A;2024-0{i};Strom;{478800 + i}.50;kWh;1.5\n" for i in range(1, 9)))
    lines = read_lines(spark, str(tmp_path))
    voted = profile.file_profile(lines).first()
    assert (voted["delimiter"], voted["number_format"], voted["has_header"]) == (";", "english", True)
    sampled = profile.file_profile(lines, sample=True).first()
    assert (sampled["delimiter"], sampled["number_format"]) == (";", "german")
    amounts = {r["line_items"][0]["consumption_kwh"] for r in Export(lines).documents().collect()}
    assert amounts == {None} | {478800.5 + i for i in range(1, 9)}
