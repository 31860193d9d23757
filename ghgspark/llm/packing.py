"""Best-fit packing of token sequences.

Best-fit decreasing looks only at lengths, and there are at most ``capacity`` of them. So the plan is made from the
histogram of lengths: all pieces of one length go to the tightest open bins at once, a segment tree over remaining
capacities finds those in logarithmic time. The result is the very packing that best-fit decreasing gives piece by
piece; the plan's size depends on the capacity alone, not on the corpus. Spark then numbers the pieces of each length
and looks their places up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ghgspark.llm.common import gapless, staged, utf8
from ghgspark.llm.pretokens import PretokenIds


class RemainingTree:
    """Segment tree over remaining capacities; a leaf tells whether bins with that much room are open."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.width)

    def set(self, room: int, is_open: bool) -> None:
        node = room + self.width
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, size: int) -> int | None:
        """Smallest open room of at least ``size``."""
        node = size + self.width
        if self.open[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return None


@dataclass(frozen=True)
class Plan:
    """Row i: pieces of ``size`` with numbers from ``rank`` on go to bins from ``bin`` on, ``per_bin`` to each, the
    first at ``offset``. Rows are sorted by size and rank."""

    size: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.int64(1) << np.int64(48)
        row = np.searchsorted(self.size * shift + self.rank, size * shift + rank, "right") - 1
        inside = rank - self.rank[row]
        return self.bin[row] + inside // self.per_bin[row], self.offset[row] + inside % self.per_bin[row] * size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Plan for counts[size] pieces of each size (1 to capacity)."""
    tree, rooms, bins, steps = RemainingTree(capacity), {}, 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0

        def fill(room: int, first: int, n: int) -> int:
            """Fill up to n bins of this room; the number of bins used."""
            nonlocal left, rank
            each = room // size
            full = min(n, left // each)
            for used, per_bin in ((full, each), (int(full < n and 0 < left - full * each), left - full * each)):
                if used:
                    steps.append((size, rank, first, per_bin, capacity - room))
                    put(room - per_bin * size, first, used)
                    rank, left, first, n = rank + used * per_bin, left - used * per_bin, first + used, n - used
                    if per_bin < each:
                        break
            put(room, first, n)
            return rank

        while left:
            room = tree.tightest(size)
            if room is None:
                n = -(-left // (capacity // size))
                first, bins = bins, bins + n
                fill(capacity, first, n)
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
                fill(room, first, n)
    columns = np.array(sorted(steps), np.int64).reshape(-1, 5).T
    return Plan(*columns, bins)


_ENCODERS: dict[str, PretokenIds] = {}


def _encoder(path: str) -> PretokenIds:
    """One encoder per worker process: the file's own model, pre-token by pre-token. Special tokens' strings in a text
    are ordinary text."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        model, letters = Tokenizer.from_file(path).model, byte_letters()
        _ENCODERS[path] = PretokenIds(
            PATTERN, lambda words: [[t.id for t in model.tokenize(w.decode("latin-1").translate(letters))] for w in words])
    return _ENCODERS[path]


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: its own if printable, else 256 and on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(documents: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and ``end_id``; longer ones cut into pieces of ``window``, of which the first may be shorter.

    A null text is empty and gives the end id alone; a null doc_id stays null. Texts are encoded whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            names, data, offsets = batch.column("doc_id").to_pylist(), *utf8(batch.column("text"))
            rows = []
            for low, ids, at in encoder.texts(data, offsets):
                ids, at = ids.astype("<u4", copy=False), at.tolist()
                for i in range(len(at) - 1):
                    whole = np.concatenate([ids[at[i]:at[i + 1]], end])
                    head = (len(whole) - 1) % window + 1
                    cuts = [0, *range(head, len(whole) + 1, window)]
                    rows += [(names[low + i], k, a, b - a, zlib.crc32(whole[a:b].tobytes()))
                             for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema.types)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset (long) to pieces with a ``length`` of 1 to ``capacity``.

    Only the histogram of lengths (at most ``capacity`` rows) and the plan made of it pass the driver. Equal lengths
    may be any share of the rows. Pieces should be staged: they are read three times.
    """
    order = ["length", *sorted(set(pieces.columns) - {"length"})]
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = best_fit_decreasing(histogram, capacity)
    ranked = gapless(pieces, ["length"], order, "_rank")
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, offsets = plan.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*names, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, f"{types}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, window: int = 2048) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece.

    Columns beside doc_id and text are not carried. An empty table gives no rows.
    """
    return pack(staged(token_pieces(documents, tokenizer, window), "pieces"), window)
