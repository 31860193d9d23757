"""Invoice texts and cell tables."""

import pytest

from ghgspark.operators import enrich, invoices
from ghgspark.sources.factors import default_factors, load_factors

DIESEL = """NRW Energie Versorgung GmbH
Customer: RuhrChem Lubricants GmbH
Site: Essen Blending Plant
Address: Vogelheimer Strasse 120, 45329 Essen, Germany
Invoice number: DI-2024-001
Invoice date: 2024-03-08
Billing period: 2024-02-01 to 2024-02-29
Currency: EUR
1 D-ESSEN-FLEET-01 Diesel - Internal logistics 2024-02-01 2024-02-29 8,500 1.4200 12,070.00
Subtotal energy charges: 12,070.00 EUR
Network & levies (approx. 5%): 603.50 EUR
VAT 19%: 2,407.97 EUR
Total amount due: 15,081.47 EUR
"""
GERMAN = """Stadtwerke Essen AG
Kunde: RuhrChem Lubricants GmbH
Standort: Essen Blending Plant
Adresse: Vogelheimer Strasse 120, 45329 Essen, Germany
Rechnungsnummer: SWE-2024-0847
Rechnungsdatum: 15.03.2024
Abrechnungszeitraum: 01.02.2024 - 28.02.2024
Waehrung: CHF
1 E-ESSEN-PLANT-01 Strom - Produktion 2024-02-01 2024-02-28 415,300 0.1810 75,169.30
Zwischensumme: 75,169.30 EUR
Netzentgelte & Umlagen (ca. 12%): 9,020.32 EUR
MwSt 19%: 15,996.03 EUR
Gesamt: 100,185.65 EUR
"""
HEADER = ["Line", "Meter ID", "Energy type", "From", "To", "Consumption (litres)", "Unit price (EUR/litre)", "Amount (EUR)"]
TABLES = [[["Note", "x"]], [HEADER, ["", None, " "], ["1", "M-1", "Erdgas", "2024-02-01", "2024-02-29", "8,500", "1.42", "12,070.00"],
                            ["2", "M-2", "Dampf"]]]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("d.pdf", "h1", DIESEL, None), ("g.pdf", "h2", GERMAN, None), ("t.pdf", "h3", DIESEL, TABLES),
            ("w.pdf", "h4", DIESEL.replace("Invoice number", "INVOICE\xa0NUMBER"), None),
            ("q.pdf", "h5", "V\nInvoice no.: X1\nSubtotal: 5.00\n", [[["a"], ["b"]]]),
            ("esg.pdf", "h6", "Some report", None), ("e.pdf", "h7", " \n", None)]
    frame = spark.createDataFrame(
        rows, "filename string, file_hash string, text string, tables array<array<array<string>>>")
    return invoices.parse_documents(frame).cache()


def by_file(frame):
    return {r["filename"]: r for r in frame.collect()}


def test_headers_and_totals(parsed):
    found = by_file(parsed)
    g = found["g.pdf"]
    assert (g["vendor_name"], g["invoice_number"], g["invoice_date"], g["currency"]) == (
        "Stadtwerke Essen AG", "SWE-2024-0847", "15.03.2024", None)
    assert (g["billing_period_from"], g["billing_period_to"]) == ("2024-02-01", "2024-02-28")
    assert (g["subtotal"], g["network_levies"], g["vat_amount"], g["total_amount"]) == (75169.30, 9020.32, 15996.03, 100185.65)
    assert found["d.pdf"]["total_amount"] == 15081.47
    assert found["w.pdf"]["invoice_number"] == "DI-2024-001"
    # "Total :" is also found inside "Subtotal:".
    assert found["q.pdf"]["total_amount"] == 5.0


def test_rejects(parsed):
    errors = {r["filename"]: r["message"] for r in enrich.parse_errors(parsed).collect()}
    assert errors == {"esg.pdf": "No invoice number found - file may not be an invoice",
                      "e.pdf": "No text extracted from PDF"}


def test_lines_from_text_and_tables(parsed):
    lines = invoices.invoice_lines(parsed).collect()
    text = [r for r in lines if r["filename"] == "d.pdf"]
    assert [(r["meter_id"], r["energy_type"], r["consumption_kwh"], r["unit_price"], r["amount_eur"], r["consumption_unit"])
            for r in text] == [("D-ESSEN-FLEET-01", "diesel", 8500.0, 1.42, 12070.0, "litres")]
    cells = [r for r in lines if r["filename"] == "t.pdf"]
    assert [(r["line_no"], r["meter_id"], r["energy_type"], r["consumption_kwh"], r["consumption_unit"]) for r in cells] == [
        (1, "M-1", "natural_gas", 8500.0, "litres"), (2, "M-2", "Dampf", None, "litres")]


def test_warnings(parsed):
    found = by_file(parsed)
    assert found["t.pdf"]["warnings"] == []
    assert found["d.pdf"]["warnings"] == ["Falling back to text-based line item extraction"]
    assert found["q.pdf"]["warnings"] == ["Falling back to text-based line item extraction",
                                          "No line items extracted from table or text"]


def test_records(spark, parsed):
    records = by_file(enrich.build_records(parsed, default_factors(spark)))
    assert records["d.pdf"]["emissions_tco2"] == pytest.approx(22.780)
    assert records["g.pdf"]["emissions_tco2"] == pytest.approx(157.814)
    assert records["g.pdf"]["currency"] == "EUR"
    assert records["d.pdf"]["content"] == (
        "Invoice d.pdf for site Essen Blending Plant covers period 2024-02-01 to 2024-02-29 for diesel energy. "
        "Energy amount is 8500.0 litres. Total cost is 15081.47 EUR.")
    assert records["q.pdf"]["content"].startswith("Invoice q.pdf for site unknown covers period None to None for unknown")
    assert records["q.pdf"]["emissions_tco2"] is None


def test_per_line_factors(spark):
    lines = spark.createDataFrame(
        [(1, 1, "electricity", "kWh", 100.0, 1.0), (1, 2, "diesel", "litres", 10.0, 2.0), (2, 1, None, "", 0.0, None)],
        "doc int, n int, energy_type string, consumption_unit string, consumption_kwh double, amount_eur double")
    factors = default_factors(spark)
    whole = {r["doc"]: r for r in enrich.line_totals(lines, "doc", ["n"], factors).collect()}
    split = {r["doc"]: r for r in enrich.line_totals(lines, "doc", ["n"], factors, per_line=True).collect()}
    assert whole[1]["emissions_tco2"] == pytest.approx(110 * 0.00038)
    assert split[1]["emissions_tco2"] == pytest.approx(100 * 0.00038 + 10 * 0.00268)
    assert whole[2]["emissions_tco2"] is None and whole[2]["consumption_unit"] == "kWh"


def test_factor_files(spark, tmp_path):
    good = tmp_path / "factors.json"
    good.write_text('{"diesel": {"value": 0.5, "unit": "u", "source": "s", "year": 2024},\n "other": '
                    '{"value": 1, "unit": "u", "source": "s", "year": 2024, "note": "n"}}')
    found = {r["name"]: r for r in load_factors(spark, str(good)).collect()}
    assert (found["diesel"]["energy_type"], found["diesel"]["value"], found["diesel"]["note"]) == ("diesel", 0.5, "")
    assert found["other"]["energy_type"] is None
    for name, content in (("bad.json", "{oops"), ("partial.json", '{"diesel": {"unit": "u"}}')):
        (tmp_path / name).write_text(content)
        assert load_factors(spark, str(tmp_path / name)).count() == 0
    assert load_factors(spark, str(tmp_path / "missing.json")).count() == 0


def test_factor_join_is_broadcast(spark, parsed):
    plan = enrich.build_records(parsed, default_factors(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
