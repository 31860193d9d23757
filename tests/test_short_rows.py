"""Short rows are counted where they are read."""

from pyspark.sql import functions as F

from ghgspark.operators.tabular import Export

HEADER, FULL, SHORT = "Werk;Zeitraum;Energieart;Verbrauch;Einheit", "A;2024-01;Strom;1,5;kWh", "A;2024-01"
LINES = [("a.csv", 0, 0, HEADER), ("a.csv", 0, 1, FULL), ("a.csv", 0, 2, SHORT), ("a.csv", 1, 0, ";;;;"), ("a.csv", 1, 1, SHORT),
         ("a.csv", None, 2, SHORT), ("only.csv", 0, 0, HEADER), ("twice.csv", 0, 0, HEADER), ("twice.csv", 0, 0, HEADER),
         ("bare.csv", 0, 0, FULL), ("bare.csv", 0, 1, FULL), ("bad.csv", 0, 0, "x"), (None, 0, 0, FULL)]


def test_short_rows_need_no_row_numbers(spark):
    export = Export(spark.createDataFrame(LINES, "file string, block bigint, pos bigint, value string"))
    found = export.skipped_rows()
    numbered = export.rows().groupBy("file").agg(F.count_if("is_short").alias("skipped_rows"))
    counts = {r["file"]: r["skipped_rows"] for r in found.collect()}
    assert counts == {"a.csv": 2, "twice.csv": 0, "bare.csv": 0} == {r["file"]: r["skipped_rows"] for r in numbered.collect()}
    def windows(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString().count("row_number()")

    assert windows(numbered) > 0 == windows(found)
    export.release()
