"""Tables seen as energy data."""

from ghgspark.plans import adapters as A

ROWS = {
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_tax double",
                 [(i // 3, i % 4, 7, i % 3, 2.0, 10.0 + i, 0.05) for i in range(40)]),
    "part": ("p_partkey long, p_type string, p_size int", [(i, t, 5) for i, t in enumerate(("LARGE", "PROMO", "SMALL", "ECONOMY"))]),
    "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", None),
    "customer": ("c_custkey long, c_name string, c_nationkey int", [(1, "C", 1)]),
    "nation": ("n_nationkey int, n_name string", [(1, "CHILE")]),
}


def test_lineitem_is_dealt_anew_only_where_its_scan_has_few_pieces(spark, tmp_path):
    found = {}
    for pieces in (1, 2 * spark.sparkContext.defaultParallelism):
        folder = str(tmp_path / str(pieces))
        for name, (schema, rows) in ROWS.items():
            frame = spark.createDataFrame(rows, schema) if rows else spark.sql(
                "select id as o_orderkey, 1L as o_custkey, timestamp '2024-03-05' as o_orderdate from range(14)")
            frame.repartition(pieces if name == "lineitem" else 1).write.parquet(f"{folder}/{name}.parquet")
        spark.conf.set("spark.sql.files.openCostInBytes", "134217728")        # a piece of the scan per file
        try:
            facts = A.invoice_facts(spark, folder)
            plan = facts._jdf.queryExecution().toString()
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert ("REPARTITION_BY_NUM" in plan) == (pieces == 1)
        found[pieces] = sorted(facts.select("doc_id", "amount", "label").collect())
    one, many = found.values()
    assert one == many and len(one) == 40
