"""Byte-level BPE by longest matches and backtracking.

The tokens, as Latin-1 strings of their bytes, are the patterns of an automaton. A pre-token is encoded from left to
right: take the longest token that starts here and that can stand after the one before, else a shorter prefix of it,
else step back. Two tokens can stand side by side if the plain merges of their joined bytes give these two again; the
answer is memoised per pair. Each position fails at most once, so the work is linear in the length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ghgspark.llm.common import ragged, utf8
from ghgspark.llm.pretokens import PretokenIds


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BytePairs:
    def __init__(self, ranks: dict[bytes, int], pair_limit: int = 1_000_000):
        self.ranks, self.pair_limit = ranks, pair_limit
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}  # the longest token that is a proper prefix; -1 without one
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """Plain merges: the lowest rank first, the leftmost of equals."""
        ranks, parts = self.ranks, [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.pair_limit:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def prefix(self, token: int) -> int:
        known = self.shorter.get(token)
        if known is None:
            word = self.tokens[token]
            known = self.shorter[token] = next(
                (self.ranks[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in self.ranks), -1)
        return known

    def encode(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None or not word:
            return [] if whole is None else [whole]
        n, tokens, pairs = len(word), self.tokens, self.pairs
        size, longest = [0] * n, [-1] * n
        for end, (length, token) in self.automaton.iter(word.decode("latin-1")):
            if length > size[begin := end - length + 1]:
                size[begin], longest[begin] = length, token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(tokens[token])
                if not dead[end]:
                    if last < 0:
                        break
                    fits = pairs.get((last, token))
                    if self.compatible(last, token) if fits is None else fits:
                        break
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this text")
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])


_CODECS: dict[str, tuple[PretokenIds, np.ndarray, np.ndarray, np.ndarray]] = {}


def _codec(path: str, pattern: str):
    """Encoder, and the vocabulary's bytes as one buffer with starts and lengths by id; one per worker process."""
    if path not in _CODECS:
        ranks = load_ranks(path)
        pairs = BytePairs(ranks)
        words = [pairs.tokens.get(i, b"") for i in range(max(ranks.values()) + 1)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        _CODECS[path] = (PretokenIds(pattern, lambda new: list(map(pairs.encode, new))),
                         np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return _CODECS[path]


def encode_decode(documents: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids.

    A null text is empty: no tokens. Rows are independent: repeated rows repeat, an empty table gives none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string()), *[("ids", pa.list_(pa.int64()))] * keep_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary, begin, size = _codec(ranks_path, pattern)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            counts, digests, decoded, kept = [], [], [], []
            for _, ids, at in encoder.texts(data, offsets):
                ids = ids.astype("<u4", copy=False)
                lengths = size[ids]
                plain = vocabulary[ragged(begin[ids], lengths)]
                ends = np.concatenate([[0], np.cumsum(lengths)])[at].tolist()
                at = at.tolist()
                for a, b, c, d in zip(at, at[1:], ends, ends[1:]):
                    counts.append(b - a)
                    digests.append(hashlib.sha256(ids[a:b]).hexdigest())
                    decoded.append(hashlib.sha256(plain[c:d]).hexdigest())
                    if keep_ids:
                        kept.append(ids[a:b].tolist())
            columns = [batch.column("doc_id").cast(pa.int64()), counts, digests, decoded, *[kept] * keep_ids]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    types = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids
    return documents.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, types)
