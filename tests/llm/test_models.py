"""Passage quality, exact search and the pipeline."""

import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from ghgspark.llm import quality, topk
from ghgspark.llm.common import gapless
from ghgspark.llm.queries import LLM_QUERIES, op5_passage_quality, op9_exact_top_k
from ghgspark.session import scratch_root
from test_sets import plain_components, plain_removal

SF = "/root/testdata/sf0.01"


# Quality ------------------------------------------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    rows = op5_passage_quality(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    test = rows[rows.held_out]
    right = (test.predicted == test.quality)
    assert right.mean() > 0.93 and right[test.quality == 0].mean() > 0.6 and right[test.quality == 1].mean() > 0.97


def test_scores_of_messy_documents(spark, messy, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (3, None, 0), (4, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(messy, labels)
    rows = quality.score_quality(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert {r["_key"] for r in rows} == {"x"}
    assert quality.score_quality(nothing, model).count() == 0
    alone = quality.train(messy, labels.where("false"))
    assert {r["score"] for r in quality.score_quality(messy, alone).collect()} == {0.5}


def test_gradients():
    """One small step against the gradient lowers the loss: attention and encoder learn together."""
    draw = np.random.default_rng(1)
    bags = []
    labels = np.array([i % 2 for i in range(80)], np.float32)
    for y in labels:
        bag = draw.poisson(1.0, (draw.integers(1, 6), quality.BUCKETS)).astype(np.float32)
        if y:
            bag[draw.integers(len(bag)), :12] += 6  # one passage alone tells
        bags.append(bag)
    model = quality.fit(bags, labels)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    scores = model.score(np.concatenate(bags), first)
    assert ((scores >= 0.5) == (labels == 1)).mean() > 0.97


# Exact search -------------------------------------------------------------------------------------------------------

def plain_top(rows, every, k, scale=64):
    good = [(i, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in good if i % every == 0}):
        q = min((v for j, v in good if j == i), key=lambda v: v.tolist())
        scores = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("block", [3, 2048])
def test_top_k(spark, block):
    draw = random.Random(6)
    rows = [(i, [draw.choice([-1.0, -0.3, 0.0, 0.2, 1.5]) for _ in range(10)]) for i in range(300)]
    rows += [(20, rows[20][1]), (33, rows[7][1]), (None, rows[1][1]), (500, None), (520, []), (540, [None] + [1.0] * 9),
             (560, [float("nan")] * 10), (580, [float("inf")] * 10), (600, [1.0, 2.0]), (620, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), 7, block=block).collect()
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got) == plain_top(rounded, 20, 7)
    assert topk.top_k(frame.where("false"), frame).count() == 0
    assert topk.top_k(frame, frame.where("false")).count() == 0


def test_search_query_and_fewer_rows_than_k(spark):
    assert op9_exact_top_k(spark, SF).count() == 25 * 20
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(frame, frame.where("vec_id = 0")).collect()] == [(0, 1, 1, 8192), (0, 2, 2, 8192)]


def test_queries_that_are_not_stored(spark):
    draw = np.random.default_rng(3)
    stored = [(i, [float(x) for x in draw.integers(-3, 4, 6)]) for i in range(60)]
    asked = [(1000 + i, [float(x) for x in 50 * draw.integers(-3, 4, 6)]) for i in range(40)]  # closer to each other than to any stored row
    kinds = "vec_id long, embedding array<float>"
    got = topk.top_k(spark.createDataFrame(stored, kinds), spark.createDataFrame(asked, kinds), 5, block=16).collect()
    wanted = []
    for q, x in asked:
        scores = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(x, y)), i) for i, y in stored)[:5]
        wanted += [(q, rank, i, -score) for rank, (score, i) in enumerate(scores, 1)]
    assert sorted(tuple(r) for r in got) == sorted(wanted)
    part = spark.createDataFrame(stored, kinds).where("vec_id % 2 = 1")  # the queries are filtered apart from the stored rows
    both = topk.top_k(part, spark.createDataFrame(stored, kinds).where("vec_id % 2 = 0"), 5).groupBy("query_id").count().collect()
    assert len(both) == 30 and {r["count"] for r in both} == {5}


def test_one_block_of_queries_at_a_time(spark, monkeypatch):
    """No block is read before the result of the one before is written, and the result's plan does not grow with them."""
    steps, search = [], topk.search_block

    def noted(ids, *rest):
        steps.append(sum(len(p.read_bytes()) for p in folder.glob("top-k-*/part-*")))
        return search(ids, *rest)

    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    folder = Path(scratch_root(spark))
    monkeypatch.setattr(topk, "search_block", noted)
    got = topk.top_k(frame, frame, 3, block=10)
    assert len(steps) == 4 and steps == sorted(set(steps))
    plan = got._jdf.queryExecution().toString()
    assert "Union" not in plan and "MapInArrow" not in plan and got.count() == 40 * 3


# Shared and whole ---------------------------------------------------------------------------------------------------

def test_gapless_numbers_of_a_hot_key(spark):
    frame = spark.range(5000).selectExpr("if(id < 4000, 0, id % 3) as k", "id")
    rows = gapless(frame, ["k"], ["id"], "n", rows_per_bucket=100).collect()
    for key in {r["k"] for r in rows}:
        own = sorted(r["n"] for r in rows if r["k"] == key)
        assert own == list(range(len(own)))


def test_pipeline_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, results = docs.toPandas(), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas()) if stage is not corpus_pipeline.STAGES[-1][1] \
            else stage(spark, docs, sf)
        results.append(docs.toPandas())
    good, single, once, masked, packed = results
    assert all(sorted(r.columns) == sorted(before.columns) for r in results[:4])
    labels = pd.read_parquet(f"{sf}/labels.parquet").merge(before, on="doc_id")
    assert labels[labels.quality == 1].doc_id.isin(good.doc_id).mean() > 0.9
    kept = {r[0] for r in plain_components(list(zip(good.doc_id, good.text)), 5, 80) if r[3]}
    assert set(single.doc_id) == kept
    wanted = {r[0]: r[2] for r in plain_removal(list(zip(single.doc_id, single.text)), 50)}
    for a, b in zip(single.sort_values("doc_id").itertuples(), once.sort_values("doc_id").itertuples()):
        assert a.doc_id == b.doc_id and len(a.text.encode()) - len(b.text.encode()) - wanted[a.doc_id] in range(0, 40)
        assert (a.text == b.text) == (wanted[a.doc_id] == 0) and b.n_chars == len(b.text)
    assert set(masked.doc_id) == set(once.doc_id)
    assert set(packed.doc_id) == set(masked.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_of_messy_documents(spark, messy, nothing, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (messy, nothing):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == frame.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_rows_of_one_id_with_other_texts_stay(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(7, None), (7, "real text of seven that nothing else is like"), (7, words), (7, words), (3, words + " 13"),
            (9, words), (None, words), (5, "alone"), (5, "alone")]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[1], rows[4], rows[6], rows[7]]))


def test_every_query_is_named_by_its_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
