"""Fingerprints, shards, near copies and repeated strings against plain versions of themselves."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ghgspark.llm import fingerprints, neardup, sharding, suffixes


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


# Fingerprints -------------------------------------------------------------------------------------------------------

def corpus(spark, n=300, seed=4):
    draw = random.Random(seed)
    words = ["w" + "".join(draw.choice("abcdefghij") for _ in range(4)) for _ in range(600)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 120))) for _ in range(n - 20)]
    texts += texts[:20]
    return spark.createDataFrame([(3 * i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_edited_fingerprints(spark):
    frame = corpus(spark)
    rows = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(frame).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in frame.collect())
    names = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        row = rows[i]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert names.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    mean = lambda k: sum(r[k] for r in rows.values()) / len(rows)
    assert mean("near_edited") > 2 * mean("near_next")


def test_lexicon_covers_the_band(spark):
    frame = spark.createDataFrame([(i, f"all w{i % 4} only{i}") for i in range(40)], "doc_id long, text string")
    bits = fingerprints.lexicon(frame, (0.1, 0.5))
    words = spark.createDataFrame([("all",), ("w1",), ("only3",), ("W2!",)], "t string").crossJoin(bits)
    sizes = {r["t"]: r["n"] for r in words.select("t", F.expr(f"size({fingerprints.terms('t', 'bits')})").alias("n")).collect()}
    assert sizes == {"all": 0, "w1": 1, "only3": 0, "W2!": 1}


@pytest.mark.parametrize("per_bucket", [1, 2, 7, 1000])
def test_next_document(spark, per_bucket):
    ids = [5, -3, 7, 7, 1000, None, 2, 9, 11]
    frame = spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r["text"]: r["_next"]["text"] for r in fingerprints.with_next(frame, ["text"], per_bucket).collect()}
    order = [str(k) for k, _ in sorted(enumerate(ids), key=lambda x: (x[1] is not None, x[1] or 0, str(x[0])))]
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_fingerprints_of_messy_documents(messy, nothing):
    rows = fingerprints.edited_fingerprints(messy).collect()
    assert len(rows) == messy.count() and len({r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert {r["n_chars"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert fingerprints.edited_fingerprints(nothing).count() == 0
    one = fingerprints.edited_fingerprints(messy.where("doc_id = 3")).collect()
    assert one[0]["near_next"] == 1.0


# Shards -------------------------------------------------------------------------------------------------------------

def test_shards(spark, messy, nothing):
    frame = messy.select("doc_id", "text").unionByName(spark.range(100, 3100).selectExpr("id as doc_id", "repeat('é', int(id % 7)) as text"))
    rows = sharding.shard_records(frame, [1.0] * 6).collect()
    assert len(rows) == frame.count()
    assert ordered((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == ordered(
        (d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in frame.collect())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 6)
    assert sorted(by) == list(range(6)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.25 * min(map(len, by.values()))
    moved = sum(r["grown_shard"] == 6 for r in rows) / len(rows)
    assert 0.1 < moved < 0.19
    again = sharding.shard_records(frame, [1.0] * 7).collect()
    grown = {r["doc_id"]: r["grown_shard"] for r in rows}
    assert all(grown[r["doc_id"]] == r["shard"] for r in again)
    assert sharding.shard_records(nothing, [1.0] * 6).count() == 0


def test_weights(spark):
    frame = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    counts = {r["shard"]: r["count"] for r in sharding.shard_records(frame, [3.0, 1.0, 0.0]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1} and 2.6 < counts[0] / counts[1] < 3.4


# Near copies --------------------------------------------------------------------------------------------------------

def plain_components(docs, width, percent):
    sets = []
    for i, text in docs:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
                 .translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
        grams = {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
        sets.append((i, grams))
    parent = {i: i for i, _ in docs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return ordered((i, len(s), i if i is None else root(i), i is None or root(i) == i) for i, s in sets)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, messy, nothing, width):
    draw = random.Random(width)
    words = ["".join(draw.choice("abcdefg") for _ in range(3)) for _ in range(300)]
    docs = []
    for _ in range(25):  # a base and copies at every distance, some of which meet only over others
        chain = [draw.choice(words) for _ in range(draw.choice([3, 8, 30, 90, 300]))]
        docs.append(" ".join(chain))
        for _ in range(draw.randint(0, 9)):
            base = chain if draw.random() < 0.6 else docs[-1].split()
            copy = [draw.choice(words) if draw.random() < draw.choice([0.005, 0.02, 0.04]) else w for w in base]
            docs.append("  ".join(copy).upper() if draw.random() < 0.2 else " ".join(copy))
    draw.shuffle(docs)
    docs = [(d["doc_id"], d["text"]) for d in messy.collect()] + [(50 + i, t) for i, t in enumerate(docs)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert ordered(neardup.near_duplicates(frame, width).collect()) == plain_components(docs, width, 80)
    assert neardup.near_duplicates(nothing, width).count() == 0


def test_large_group_of_near_copies(spark):
    draw = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(400):
        copy = list(base)
        for _ in range(draw.randint(0, 9)):
            copy[draw.randrange(120)] = f"x{draw.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert ordered(neardup.near_duplicates(frame, 2).collect()) == plain_components(docs, 2, 80)


def test_many_short_texts_meet_in_bounded_memory():
    n = 6000  # short sets that all share one value: 36 million cells
    sets = np.repeat(np.arange(n), 3)
    values = np.stack([np.zeros(n, np.int64), 1 + np.arange(n) // 2, 10**6 + np.arange(n) // 2 * (np.arange(n) % 3 > 0)], axis=1).reshape(-1)
    sizes = np.full(n, 3)
    tracemalloc.start()
    found = [np.stack(pair) for pair in neardup.close((sets, values), (sets, values), sizes, sizes, 80, 1 << 20)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = {}
    for i, row in enumerate(values.reshape(n, 3).tolist()):
        own.setdefault(frozenset(row), []).append(i)
    wanted = sorted((i, j) for same in own.values() for i in same for j in same)
    assert sorted(map(tuple, np.concatenate(found, axis=1).T.tolist())) == wanted
    assert peak < 64 << 20  # one dense matrix of all cells would be 288 MB


def test_blocks_of_short_texts_are_bounded(spark, monkeypatch):
    """Texts that share two words with a hub and are linked with other texts, in meetings of few texts."""
    draw = random.Random(6)
    docs = []
    for i in range(60):
        own = ["the", "word"] + [f"w{draw.randrange(10**6)}" for _ in range(draw.randint(1, 9))]
        docs += [" ".join(own), " ".join([*own, "more"])]
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept, most = neardup.staged, []

    def noted(made, label):
        out = kept(made, label)
        if label == "meetings":
            at = out.groupBy("meeting").agg(F.count_if(F.expr("role in (2, 3)")).alias("a"), F.count_if(F.expr("role in (1, 3)")).alias("b"))
            most.append(tuple(at.agg(F.max("a"), F.max("b"), F.count("*")).first()))
        return out

    monkeypatch.setattr(neardup, "staged", noted)
    monkeypatch.setattr(neardup.outside_links, "__defaults__", (1 << 18, 1 << 20, 8, 16))
    assert ordered(neardup.near_duplicates(frame, 2).collect()) == plain_components(docs, 2, 80)
    assert most and most[0][2] > 1 and most[0][0] <= 24 and most[0][1] <= 40


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (200, 150), (150, 160)], "u long, v long")
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 150: 150, 160: 150, 200: 150}
    assert neardup.components(links.where("false")).count() == 0


# Repeated strings ---------------------------------------------------------------------------------------------------

def test_suffix_array_and_common_prefixes():
    draw = random.Random(3)
    for _ in range(200):
        x = np.array([draw.randint(0, draw.choice([1, 2, 5])) for _ in range(draw.randint(1, 150))] + [0], np.uint8)
        text, order = bytes(x), suffixes.two_stage_suffix_array(x, 16)
        assert sorted(order.tolist()) == list(range(len(x)))
        heads = [text[i:i + 16].ljust(16, b"\0") for i in order]
        assert heads == sorted(heads)
        for i, n in enumerate(suffixes.common_prefixes(x, order, 16).tolist()):
            same = 0 if i == 0 else next((k for k in range(16) if heads[i][k] != heads[i - 1][k]), 16)
            assert n == same


def plain_removal(docs, length):
    out, seen = [], {}
    nobody = float("inf")
    for i, text in docs:
        raw, name = (text or "").encode(), nobody if i is None else i
        for p in range(len(raw) - length + 1):
            window = raw[p:p + length]
            seen[window] = min(seen.get(window, nobody), name)
    for i, text in docs:
        raw, name = (text or "").encode(), nobody if i is None else i
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen[raw[p:p + length]] < name:
                gone[p:p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("length", [8, 21, 50])
def test_remove_repeats(spark, messy, nothing, length):
    draw = random.Random(length)
    letters = "ab é\n"
    passages = ["".join(draw.choice(letters) for _ in range(draw.randint(20, 200))) for _ in range(12)]
    passages += ["a" * 120, "ab" * 70, "🙂é" * 30]
    docs = [(d["doc_id"], d["text"]) for d in messy.collect() if d["doc_id"] != 3] + [(3, "many words " * 300), (9, "many words " * 40)]
    for i in range(150):
        parts = [draw.choice(passages) if draw.random() < 0.3 else "".join(draw.choice("abcdefgh ñ") for _ in range(draw.randint(0, 90)))
                 for _ in range(draw.randint(0, 6))]
        docs.append((draw.randint(20, 150), "".join(p[draw.randint(0, 9):] for p in parts)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffixes.remove_repeats(frame, length, part_bytes=4000, group_bytes=9000).collect()
    assert ordered((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_removal(docs, length)
    assert suffixes.remove_repeats(nothing).count() == 0


def test_removal_keeps_other_columns(messy):
    rows = suffixes.remove_repeats(messy.withColumn("n_chars", F.length("text"))).collect()
    assert len(rows) == messy.count() and {r["_key"] for r in rows} == {"x"} and {r["to"] for r in rows} == {"x"}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert {r["lang"] for r in rows} == {None, "en", "de"}
