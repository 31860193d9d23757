"""More questions than one block holds, and the staged record index: what is multiplied or shuffled."""

import numpy as np

from ghgspark.operators import nearest
from ghgspark.plans import adapters as A


def drawn(spark, count, seed, key):
    x = np.round(np.random.default_rng(seed).normal(size=(count, 6)), 2)
    names = [None if key == "query_id" and i % 2 else f"{key}{i:04d}" for i in range(count)]
    return spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], f"{key} string, embedding array<double>")


def test_blocks_of_questions_are_dealt_by_row_and_nothing_is_multiplied(spark, monkeypatch):
    """Half of the questions have no id: blocks stay bounded, and the plan left to run neither copies nor searches rows."""
    index, asked = drawn(spark, 500, 1, "id").repartition(3), drawn(spark, 90, 2, "query_id")
    sizes, shared = [], nearest._shared
    monkeypatch.setattr(nearest, "_shared", lambda s, q, *more: sizes.append(q.num_rows) or shared(s, q, *more))
    blocked = nearest.top_k(index, asked, 3, broadcast_numbers=0, block_numbers=6 * 30)
    plan = blocked._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "InArrow" not in plan
    assert sum(sizes) == 90 and max(sizes) <= 30 + spark.sparkContext.defaultParallelism
    whole = nearest.top_k(index, asked, 3)
    assert max(sizes[-1:]) == 90
    rows = lambda frame: sorted((str(r["query_id"]), r["rank"], r["id"], r["distance"]) for r in frame.collect())
    assert rows(blocked) == rows(whole) and blocked.count() == 3 * 46


def test_an_index_in_enough_pieces_is_not_shuffled(spark):
    pieces = nearest.PIECES_PER_CORE * spark.sparkContext.defaultParallelism
    index = drawn(spark, 400, 3, "id").repartition(pieces)
    for count, dealt in ((pieces, False), (1, True)):
        # The frame as it is read back, in so many pieces.
        read = spark.createDataFrame(index.rdd.coalesce(count), index.schema)
        organised, _ = nearest.organise(read, 6, rows_per_block=20)
        plan = organised._jdf.queryExecution().optimizedPlan().toString()
        assert ("Repartition" in plan) == dealt and "FlatMapGroups" not in plan
        frame = organised.toPandas()
        blocks = frame[frame.kind == 1].groupby("block")
        assert len(frame[frame.kind == 1]) == 400 and blocks.size().max() <= 20
        assert (frame.kind == 0).sum() == len(blocks)


def test_texts_of_records_are_written_out_after_the_last_shuffle(spark, tmp_path, monkeypatch):
    tables = {
        "lineitem": "select id div 3 as l_orderkey, id % 4 as l_partkey, 7L as l_suppkey, int(id % 3) as l_linenumber, "
                    "2D as l_quantity, 10D + id as l_extendedprice, timestamp '2024-03-05' as l_shipdate from range(40)",
        "part": "select id as p_partkey, element_at(array('LARGE', 'PROMO', 'SMALL', 'ECONOMY'), int(id + 1)) as p_type from range(4)",
        "orders": "select id as o_orderkey, 1L as o_custkey, timestamp '2024-03-05' as o_orderdate from range(15)",
        "customer": "select 1L as c_custkey, 'C' as c_name, 1 as c_nationkey",
        "nation": "select 1 as n_nationkey, 'CHILE' as n_name",
    }
    for name, rows in tables.items():
        spark.sql(rows).write.parquet(f"{tmp_path}/{name}.parquet")
    built = []
    monkeypatch.setattr(A, "staged", lambda s, f, l, build: built.append(build()) or built[-1])
    found = A.record_documents(spark, str(tmp_path))
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line)
    above = [line for line in lines[:dealt] if "Exchange" in line]
    assert not above and "Invoice " not in "".join(lines[dealt:]) and "energy. Energy" not in "".join(lines[dealt:])
    plain = {r["pdf_hash"]: r for r in A.invoice_records(spark, str(tmp_path)).collect()}
    assert {r["id"]: r["document"] for r in found.collect()} == {h: r["content"] for h, r in plain.items()}
    assert len(plain) == 15 and sum(r["consumption_kwh"] == 0 for r in plain.values()) == 1
