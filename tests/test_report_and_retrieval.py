"""Report, sinks, index, nearest neighbours, comparison, context and jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ghgspark.functions.embedding import hashed_terms, model_embedder
from ghgspark.operators import compare, context, index, nearest, report
from ghgspark.plans import jobs
from ghgspark.schemas import RECORD_COLUMNS
from ghgspark.sources import listing
from ghgspark.sources import records as sinks
from ghgspark.sources.factors import default_factors
from ghgspark.streaming.records import index_stream

SCHEMA = ", ".join(f"{n} {k}" for n, k in RECORD_COLUMNS.items())
BASE = dict(filename="a.pdf", pdf_hash="h", vendor_name="V", customer_name="C", site="S", invoice_number="I",
            invoice_date="2024-01-01", billing_period_from="2024-01", billing_period_to="2024-01",
            energy_type="electricity", consumption_kwh=0.0, consumption_unit="kWh", total_eur=100.0, currency="EUR",
            emissions_tco2=0.0, emission_factor_value=0.00038, emission_factor_source="UBA", content="text")


def records(spark, *rows):
    return spark.createDataFrame([tuple({**BASE, **r}[n] for n in RECORD_COLUMNS) for r in rows], SCHEMA)


def test_report(spark):
    frame = records(
        spark,
        dict(consumption_kwh=478800.0, emissions_tco2=181.944),
        dict(energy_type="natural_gas", consumption_kwh=310800.0, emissions_tco2=62.782, billing_period_from="2023-01"),
        dict(energy_type="diesel", consumption_kwh=8500.0, emissions_tco2=22.780, billing_period_to="2024-06"),
        dict(energy_type="Dampf", consumption_kwh=5.0, emissions_tco2=None),
        dict(energy_type=None, consumption_kwh=7.0),
    )
    row = report.report(frame).first()
    assert (row["total_energy_mwh"], row["scope1_tco2eq"], row["scope2_tco2eq"]) == (874.88, 85.56, 181.94)
    assert (row["records_count"], row["period_start"], row["period_end"]) == (5, "2023-01", "2024-06")
    assert row["warnings"][0] == "Unknown energy type 'Dampf' with 5.0 consumption excluded from MWh total"
    assert row["warnings"][1].startswith("Data spans 17 months (2023-01 to 2024-06)")
    assert report.unknown_types(frame).first()["warning"] == (
        "Unknown energy type 'Dampf' with 5.0 consumption excluded from MWh total")
    values = report.named_values(report.report(frame, turnover=5.0)).collect()
    assert len(values) == 11 and values[0]["value_double"] == 874.88 and values[7]["value_double"] == 5.0


def test_report_of_huge_values(spark):
    frame = records(spark, dict(consumption_kwh=1e21, energy_type="electricity"), dict(consumption_kwh=1e21, energy_type="electricity"))
    row = report.report(frame).first()
    assert row["electricity_mwh"] == 2e18 and any("exact range" in w for w in row["warnings"])
    assert report.totals_by_type(frame).first()["consumption_kwh"] == 2e21


def test_report_without_periods(spark):
    row = report.report(records(spark, dict(billing_period_from=" ", billing_period_to=None))).first()
    assert (row["period_start"], row["period_end"]) == ("unknown", "unknown")
    assert row["warnings"] == ["No billing period data found in CSV"]


def test_record_csv(spark, tmp_path):
    frame = records(spark, dict(consumption_kwh=0.12345, site='A "x", y', total_eur=None))
    path = str(tmp_path / "r")
    assert sinks.write_records_csv(frame, path)
    back = sinks.read_records_csv(spark, path).first()
    assert (back["consumption_kwh"], back["site"], back["total_eur"], back["emission_factor_value"]) == (
        0.1235 if f"{0.12345:.4f}" == "0.1235" else 0.1234, 'A "x", y', None, 0.0004)
    assert not sinks.write_records_csv(frame.limit(0), str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        sinks.read_records_csv(spark, str(tmp_path / "none"))
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        sinks.read_records_csv(spark, str(tmp_path / "bad.csv"))
    sinks.copy_records(spark, path, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_index(spark, tmp_path):
    store = index.RecordIndex(spark, str(tmp_path / "index"))
    assert store.count() == 0
    first = records(spark, *[dict(pdf_hash=f"h{i}", content=f"text {i}", site=None) for i in range(20)])
    assert store.upsert(index.index_documents(first)) == 20
    assert store.upsert(index.index_documents(first)) == 20 and store.count() == 20
    twice = records(spark, dict(pdf_hash="h3", content="old", filename="a"), dict(pdf_hash="h3", content="new", filename="b"))
    assert store.upsert(index.index_documents(twice)) == 1
    found = {r["id"]: r for r in store.documents().collect()}
    assert len(found) == 20 and found["h3"]["document"] == "new" and found["h4"]["metadata"]["site"] == ""
    assert store.upsert(index.index_documents(first.limit(0))) == 0
    assert tuple(store.health().first()) == ("ok", "energy_records", 20)
    store.delete_all()
    assert store.count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_both_ways(spark, metric):
    rng = np.random.default_rng(5)
    stored = rng.integers(-2, 3, size=(300, 6)).astype(float)
    asked = rng.integers(-2, 3, size=(40, 6)).astype(float)
    stored[100:160] = stored[0]  # a crowd of copies
    vectors = spark.createDataFrame([(f"v{i:03d}", v.tolist(), i % 3) for i, v in enumerate(stored)],
                                    "id string, embedding array<float>, label int").repartition(5)
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, embedding array<float>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    a, b = (unit(asked), unit(stored)) if metric == "cosine" else (asked, stored)
    d = ((a[:, None] - b[None]) ** 2).sum(-1) / (2 if metric == "cosine" else 1)
    for size in (2_000_000, 60):
        hits = nearest.top_k(vectors, questions, 5, metric=metric, broadcast_numbers=size, block_numbers=300)
        found = hits.orderBy("query_id", "rank").collect()
        assert len(found) == 200
        got = np.array([r["distance"] for r in found]).reshape(40, 5)
        assert np.allclose(got, np.sort(d, axis=1)[:, :5], atol=1e-9)
        if metric == "l2":
            order = np.lexsort((np.broadcast_to(np.arange(300), d.shape), np.round(d, 9)), axis=1)[:, :5]
            assert [r["id"] for r in found] == [f"v{i:03d}" for i in order.ravel()]
    only = nearest.top_k(vectors, questions, 200, filters={"label": {"$eq": 1}})
    assert only.count() == 40 * 100
    assert nearest.top_k(vectors.limit(0), questions).count() == 0


def hit(rank, energy_type, period, cost, kwh, emitted, filename=None):
    meta = (filename or f"f{rank}.pdf", "Site", energy_type, period, period, kwh, cost, emitted, "EUR", "I", "V", "kWh")
    return (1, f"id{rank}", rank, 0.5, "text", meta)


def hits_frame(spark, *rows):
    return spark.createDataFrame(list(rows), f"query_id int, id string, rank int, distance double, document string, metadata {index.METADATA}")


def test_comparison(spark):
    two = hits_frame(spark, hit(2, "electricity", "2024-02-01", 102340.0, 511700.0, 194.45),
                     hit(1, "electricity", "2024-01-01", 95760.0, 478800.0, 181.94), hit(3, "natural_gas", "2024-01-01", 1.0, 1.0, 1.0))
    text = compare.analytics_text(two).first()["analytics"]
    assert text == ("=== COMPUTED ANALYTICS ===\n\n[electricity] 2024-01-01 -> 2024-02-01 (2 invoices)\n"
                    "  Total cost: 95760.00 EUR -> 102340.00 EUR (diff: +6580.00 EUR, +6.87%)\n"
                    "  Consumption: 478800.00 kWh -> 511700.00 kWh (diff: +32900.00 kWh, +6.87%)\n"
                    "  Emissions: 181.94 tCO2 -> 194.45 tCO2 (diff: +12.51 tCO2, +6.88%)")
    changes = compare.first_last(two, ["query_id"]).collect()
    assert [round(r["difference"], 2) for r in changes] == [6580.0, 32900.0, 12.51]


def test_comparison_gaps(spark):
    gaps = hits_frame(spark, hit(1, "electricity", "2024-01", 0.0, 5.0, None), hit(2, "electricity", "2024-02", 6580.0, 6.0, 1.0),
                      hit(3, "electricity", "2024-03", 7.0, 7.0, 1.0))
    text = compare.analytics_text(gaps).first()["analytics"]
    assert "  Total cost: 0.00 -> 6580.00 -> 7.00 EUR" in text and "Emissions" not in text
    assert "First vs Last -- Total cost: 0.00 -> 7.00 EUR (diff: +7.00 EUR)" in text
    row = compare.series(gaps).first()
    assert row["periods"] == ["2024-01", "2024-02", "2024-03"] and row["emissions_tco2_series"] is None
    assert compare.analytics_text(gaps.where("rank = 1")).count() == 0


def test_context(spark):
    hits = hits_frame(spark, hit(1, "diesel", "2024-01", 1.0, 1.0, 1.0, "A"), hit(2, "diesel", "2024-02", 1.0, 1.0, 1.0, "B"),
                      hit(3, "gas", "2024-01", 1.0, 1.0, 1.0, "A"))
    questions = spark.createDataFrame([(1, "How much?"), (2, "None?")], "query_id int, question string")
    user = context.prompts(questions, hits, "Be brief.").first()["user"]
    assert user.startswith("CONTEXT:\n=== DOCUMENT 1 ===\nSource: A\nSite: Site\nPeriod: 2024-01 to 2024-01\nEnergy type: diesel\n---\ntext\n"
                           "==================\n\n=== DOCUMENT 2 ===")
    assert "=== COMPUTED ANALYTICS ===" in user and user.endswith("\n\nQUESTION: How much?")
    assert [tuple(r) for r in context.distinct_sources(hits).orderBy("first_rank").collect()] == [(1, "A", 1), (1, "B", 2)]
    states = {r["query_id"]: r["status"] for r in context.statuses(questions, hits, hits).collect()}
    assert states == {1: "ok", 2: "No relevant documents found for your question."}
    empty = {r["status"] for r in context.statuses(questions, hits.limit(0), hits.limit(0)).collect()}
    assert empty == {"No documents indexed."}


def test_embedding(spark):
    frame = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    found = [np.array(r[0]) for r in hashed_terms(frame, "t").select("embedding").collect()]
    assert sorted(found[0][found[0] > 0].round(4)) == [0.4472, 0.8944] and not found[1].any() and not found[2].any()

    def make():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)

    short = spark.createDataFrame([("abc",), ("x",)], "t string")
    assert [r[0] for r in model_embedder(make)(short, "t", "e").select("e").collect()] == [[3.0, 1.0], [1.0, 1.0]]


def test_admission(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"x")
    (tmp_path / "a b.pdf").write_bytes(b"")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.txt").write_text("no")
    files = listing.list_inputs(spark, str(tmp_path))
    wanted = spark.createDataFrame([("b.pdf",), ("zz.pdf",)], "file string")
    found = {r["file"]: (r["admitted"], r["error"]) for r in listing.admit(files, wanted).collect()}
    assert found == {"b.pdf": (True, None), "zz.pdf": (False, "File not found: zz.pdf")}
    empty = spark.createDataFrame([("x.pdf", "pdf", 0), ("y.csv", "csv", 0)], listing.LISTING)
    assert [(r["admitted"], r["error"]) for r in listing.admit(empty).orderBy("file").collect()] == [
        (False, "Empty file: x.pdf"), (False, None)]
    big = spark.createDataFrame([("x.pdf", "pdf", 10_000_001)], listing.LISTING)
    assert listing.admit(big, max_bytes=10_000_000).first()["error"] == "File too large (>10 MB): x.pdf"
    assert listing.admit(big).first()["admitted"]
    assert len(listing.file_hashes(spark, str(tmp_path)).collect()) == 1


def test_parse_ask_report(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "e.csv").write_text("Werk;Zeitraum;Energieart;Verbrauch;Einheit;Kosten\nEssen;2024-01;Strom;100,0;MWh;5,0\nEssen;2024-02;Strom;50,0;MWh;6,0\n")
    (folder / "d.pdf").write_bytes(b"x")
    (folder / "r.pdf").write_bytes(b"y")
    documents = spark.createDataFrame(
        [("d.pdf", "h1", "V\nInvoice number: N1\n1 M-1 Diesel 2024-01-01 2024-01-31 1,000 1.0 9.00\nTotal: 9.00"), ("r.pdf", "h2", "report")],
        "filename string, file_hash string, text string")
    store = index.RecordIndex(spark, str(tmp_path / "index"))
    result = jobs.parse(spark, str(folder), str(tmp_path / "out"), documents, store=store)
    assert result.counters.first().asDict() == {"total_files": 2, "pdf_files": 2, "csv_files": 1, "successful": 3, "failed": 1, "skipped_rows": 0}
    assert store.count() == 3
    questions = spark.createDataFrame([("q", "electricity in Essen 2024-02")], "query_id string, question string")
    answers = jobs.ask(questions, store.documents(), "Be brief.", k=2)
    assert answers.statuses.first()["status"] == "ok" and answers.sources.count() == 2 and "QUESTION" in answers.prompts.first()["user"]
    row, values = jobs.export_report(spark, result.records_path)
    assert row.first()["total_energy_mwh"] == 160.03 and values.count() == 10


def test_stream_into_index(spark, tmp_path):
    source = tmp_path / "docs"
    text = "V\nInvoice number: N{0}\n1 M-1 Diesel 2024-01-01 2024-01-31 1,000 1.0 9.00\nTotal: 9.00"
    schema = "filename string, file_hash string, text string"
    store = index.RecordIndex(spark, str(tmp_path / "index"))
    for batch in ([1, 2], [2, 3]):
        spark.createDataFrame([(f"{i}.pdf", f"h{i}", text.format(i)) for i in batch], schema).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        index_stream(stream, default_factors(spark), store, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["id"] for r in store.documents().select("id").collect()) == ["h1", "h2", "h3"]
    assert store.documents().where(F.col("metadata.energy_type") == "diesel").count() == 3


def test_parse_accounts_for_every_document(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, raw in (("a.pdf", b"x"), ("empty.pdf", b""), ("blank.pdf", b"y"), ("untold.pdf", b"z")):
        (folder / name).write_bytes(raw)
    text = "V\nInvoice number: N1\n1 M-1 Diesel 2024-01-01 2024-01-31 1,000 1.0 9.00\nTotal: 9.00"
    documents = spark.createDataFrame(
        [("a.pdf", "h1", text), ("empty.pdf", "h2", text), ("blank.pdf", "h3", " \u00a0\n"), ("absent.pdf", "h4", text)],
        "filename string, file_hash string, text string")
    result = jobs.parse(spark, str(folder), str(tmp_path / "out"), documents)
    messages = {r["filename"]: r["message"].split(":")[0] for r in result.errors.collect()}
    assert messages == {"empty.pdf": "File not found", "absent.pdf": "File not found", "blank.pdf": "No text extracted from PDF",
                        "untold.pdf": "No text extracted from PDF"}
    counters = result.counters.first()
    assert counters["successful"] + counters["failed"] == counters["total_files"] == 5


def test_vectors_that_are_no_numbers(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(20, [float("nan"), 1.0]), (21, None), (22, [None, 1.0]), (23, [float("inf"), 0.0])]
    stored = spark.createDataFrame(rows, "id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([("q", [3.0, 1.0]), ("bad", [float("nan"), 0.0])], "query_id string, embedding array<float>")
    assert [r["id"] for r in nearest.top_k(stored, asked, 3).orderBy("rank").collect()] == [3, 2, 4]
    assert {r["id"]: r["reason"] for r in nearest.unusable(stored).collect()} == {20: "not finite", 21: "no vector", 22: "not finite", 23: "not finite"}


def test_index_reopened_and_compacted(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = records(spark, *[dict(pdf_hash=f"h{i}", content=f"text {i}") for i in range(10)])
    index.RecordIndex(spark, path).upsert(index.index_documents(rows))
    store = index.RecordIndex(spark, path)
    store.upsert(index.index_documents(rows))
    before = {r["id"] for r in store.documents().collect()}
    store.compact()
    assert store.documents().count() == 10 == store.count() and {r["id"] for r in store.documents().collect()} == before


def test_record_csv_keeps_line_ends(spark, tmp_path):
    odd = 'a\nb\r\\n "q", \\'
    path = str(tmp_path / "r")
    sinks.write_records_csv(records(spark, dict(energy_type=odd), dict(energy_type=None)), path)
    assert sorted(str(r["energy_type"]) for r in sinks.read_records_csv(spark, path).collect()) == sorted([odd, "None"])


def test_hits_of_user_turns_are_searched_once(spark, monkeypatch):
    """The queries over hits read stored hits: their plans hold no search, however often they use the hits."""
    from ghgspark.functions.embedding import hashed_terms
    from ghgspark.plans import adapters, queries

    questions = spark.createDataFrame([("1-0", "gas in Essen"), ("2-0", "power of Ulm")], "query_id string, question string")
    rows = spark.createDataFrame([("a", "gas Essen"), ("b", "power Ulm"), ("c", "diesel")], "id string, document string")
    stored = hashed_terms(rows, "document").selectExpr(
        "id", "document", "embedding", "named_struct('filename', id, 'site', '', 'energy_type', 'gas', "
        "'billing_period_from', id, 'billing_period_to', id, 'total_eur', 1D, 'consumption_kwh', 2D, "
        "'emissions_tco2', 3D) as metadata")
    monkeypatch.setattr(adapters, "user_questions", lambda *_: questions)
    monkeypatch.setattr(adapters, "record_documents", lambda *_: stored)
    for name in ("prompts", "compare_hits", "compare_text", "context_blocks", "sources", "sources_distinct"):
        found = queries.QUERIES[name](spark, "")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "InArrow" not in plan and "applyInArrow" not in plan and "search(" not in plan, name
        assert found.count()
    first = {r["query_id"]: r["filename"] for r in queries.QUERIES["sources"](spark, "").where("rank = 1").collect()}
    assert first == {"1-0": "a", "2-0": "b"}
