"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from counts of its byte pairs; a gated attention (tanh and
sigmoid branches) weighs the encoded passages; the weighted mean gives the score. Encoder, attention and score are
learned together from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ghgspark.llm.common import blocks, utf8

PASSAGE = 512
BUCKETS = 512
#: Bounds of what is fitted: labelled documents, and passages of each, taken at even distances.
SAMPLE_DOCUMENTS = 3000
SAMPLE_PASSAGES = 24

_PAIR = np.random.default_rng(7).integers(0, BUCKETS, 65536).astype(np.int32)


def passage_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of byte pairs per passage (hashed to BUCKETS columns), and the first passage of each text.

    Texts are cut every PASSAGE bytes and used whole; an empty text is one passage without pairs.
    """
    sizes = np.diff(offsets)
    each = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(each)])
    out = np.zeros((int(first[-1]), BUCKETS), np.float32)
    if len(data) > 1:
        text = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(data)) - offsets[text]
        passage = first[text] + place // PASSAGE
        pair = _PAIR[data[:-1].astype(np.int32) * 256 + data[1:]]
        inside = passage[:-1] == passage[1:]
        out += np.bincount(passage[:-1][inside] * BUCKETS + pair[inside], minlength=out.size).reshape(out.shape)
    return out, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def prepare(self, counts: np.ndarray) -> np.ndarray:
        return (np.log1p(counts) - self.mean) * self.scale

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"]
        starts, sizes = first[:-1], np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        attention = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        logit = z @ w["c"] + w["d"][0]
        return {"h": h, "t": t, "s": s, "attention": attention, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def score(self, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        if "W" not in self.weights:
            return np.full(len(first) - 1, self.weights["prior"][0])
        return self.forward(self.prepare(counts), first)["p"]


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 25, batch: int = 64,
        rate: float = 0.003, decay: float = 1e-3, seed: int = 11) -> Model:
    """Adam on the log-loss. Sizes and decay were compared on labelled rows (see README). With one class
    alone, or none, every score is the smoothed share of label 1."""
    if len(bags) < 2 or labels.min() == labels.max():
        prior = (float(labels.sum()) + 1) / (len(labels) + 2)
        return Model(np.zeros(0), np.zeros(0), {"prior": np.array([prior])})
    rng = np.random.default_rng(seed)
    logs = np.log1p(np.concatenate(bags))
    model = Model(logs.mean(axis=0), (1 / (logs.std(axis=0) + 0.1)).astype(np.float32), {})
    bags = [model.prepare(b).astype(np.float32) for b in bags]
    w = model.weights
    w |= {"W": rng.normal(0, BUCKETS**-0.5, (BUCKETS, hidden)), "b": np.zeros(hidden),
          "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)),
          "a": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    w |= {k: v.astype(np.float32) for k, v in w.items()}
    m, v, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
            x, y = np.concatenate([bags[i] for i in part]), labels[part]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in part])])
            sizes = np.diff(first)
            f = model.forward(x, first)
            h, t, s, attention = f["h"], f["t"], f["s"], f["attention"]
            d_logit = ((f["p"] - y) / len(part)).astype(np.float32)
            d_z = np.repeat(d_logit[:, None] * w["c"], sizes, axis=0)
            d_att = (d_z * h).sum(axis=1)
            d_e = attention * (d_att - np.repeat(np.add.reduceat(attention * d_att, first[:-1]), sizes))
            d_gate = d_e[:, None] * w["a"]
            d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
            d_h = (attention[:, None] * d_z + d_t @ w["V"].T + d_s @ w["U"].T) * (1 - h * h)
            grads = {"W": x.T @ d_h, "b": d_h.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_s, "a": (t * s).T @ d_e,
                     "c": f["z"].T @ d_logit, "d": np.array([d_logit.sum()])}
            step += 1
            for k, g in grads.items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                move = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                w[k] = (w[k] - move).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, documents_bound: int = SAMPLE_DOCUMENTS,
          passages_bound: int = SAMPLE_PASSAGES) -> Model:
    """Fit on at most ``documents_bound`` labelled documents (the smallest hashes of doc_id among rows that are not held
    out) and ``passages_bound`` passages of each. Null or conflicting labels: the null is left out, the smaller counts."""
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents_bound)
    )
    # At most documents_bound rows of two numbers.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            packed = []
            for low, high in blocks(offsets, 1 << 18):
                counts, first = passage_counts(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                for a, b in zip(first, first[1:]):
                    pick = np.unique(np.linspace(a, b - 1, min(b - a, passages_bound)).astype(int))
                    packed.append(counts[pick].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(packed, pa.binary())],
                names=["doc_id", "quality", "packed"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    sample = rows.mapInArrow(encode, f"doc_id {kind}, quality int, packed binary").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["packed"]))
    bags = [np.frombuffer(r["packed"], np.uint16).reshape(-1, BUCKETS).astype(np.float32) for r in sample]
    return fit(bags, np.array([r["quality"] for r in sample], np.float32))


def score_quality(documents: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The documents with a score (double) and a prediction (int, 1 from 0.5 on), from the whole text alone.

    A null text is empty and has a score too. Every other column passes through, but for columns of the new ``names``,
    which give way; an empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            scores = [
                model.score(*passage_counts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))
                for a, b in blocks(offsets, 1 << 18)
            ]
            score = np.concatenate([np.zeros(0), *scores]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=[*batch.schema.names, *names])

    kept = documents.drop(*names)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{types}, `{names[0]}` double, `{names[1]}` int")
