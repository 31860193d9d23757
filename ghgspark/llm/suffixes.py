"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id. Candidates come first:
every such string holds a position that its own bytes pick, the smallest hash of its 20-byte substrings. Consecutive
strings with one such position form a context. Contexts travel as hashes by the hash of the picked substring; only where
different contexts meet at one substring, one context of each kind is fetched as bytes. Their suffixes are sorted in two
stages, common prefixes of neighbours tell equal strings, and the smallest document of each is known.

Copies therefore cost one hash per context however many there are, and all work is dealt out by hashes of content.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ghgspark.llm.common import BASE, BYTE_VALUES, blocks, mix, powers, ragged, staged, utf8

GRAM = 20
NOBODY = (1 << 63) - 1  # in place of a null id: not smaller than any other
INVERSE = pow(BASE, -1, 1 << 64)

#: A context on its way: 32 bits of the picked substring's hash beside the part's number, and 48 bits of its own.
ENTRY = np.dtype([("gram", "<u4"), ("context", "<u4"), ("more", "<u2"), ("doc", "<u2"), ("start", "<u4"), ("count", "u1")])
MARK = np.dtype([("doc", "<i8"), ("key", "<i8"), ("group", "<i8"), ("start", "<u4"), ("count", "<u4")])


# Suffix arrays ------------------------------------------------------------------------------------------------------

def words(text: np.ndarray, reach: int) -> np.ndarray:
    """The eight bytes from every position on as a big-endian number, with ``reach`` zeros behind the end."""
    x = np.concatenate([text, np.zeros(reach + 8, np.uint8)]).astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def two_stage_suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (it ends with a 0) in the order of their first ``depth`` bytes at least.

    First stage: the suffixes smaller than their successors are sorted directly, by eight bytes at a time. Second stage:
    buckets of first bytes are scanned in order; a suffix whose predecessor is larger than it puts the predecessor at
    the front of that one's bucket. A bucket's additions to itself are scanned after what was there before.
    """
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    after = np.searchsorted(differs, np.arange(n))
    smaller = np.zeros(n, bool)
    inside = after < len(differs)
    at = differs[after[inside]]
    smaller[inside] = text[at] < text[at + 1]

    eight, chosen = words(text, depth + 8), np.flatnonzero(smaller)
    keys = [eight[chosen + k] for k in range(0, depth, 8)]
    chosen = chosen[np.lexsort(keys[::-1])]

    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    tails = np.bincount(text[chosen], minlength=256)
    order = np.empty(n, np.int64)
    order[ragged(ends - tails, tails)] = chosen
    front = ends - sizes

    def put(suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            kinds = text[before]
            stable = np.argsort(kinds, kind="stable")
            counts = np.bincount(kinds, minlength=256)
            order[ragged(front, counts)] = before[stable]
            front[:] += counts

    order[front[text[-1]]] = n - 1
    front[text[-1]] += 1
    for c in np.flatnonzero(sizes):
        scanned = ends[c] - sizes[c]
        while scanned < front[c]:
            low, scanned = scanned, int(front[c])
            put(order[low:scanned])
        put(order[ends[c] - tails[c]:ends[c]])
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``order``, up to ``depth``; 0 for the first."""
    eight = words(text, depth + 8)
    found = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for k in range(0, depth, 8):
        gap = eight[order[alive] + k] ^ eight[order[alive - 1] + k]
        same = gap == 0
        part = ~same
        leading = np.zeros(int(part.sum()), np.int64)
        rest = gap[part]
        for shift in range(1, 8):
            leading += (rest >> np.uint64(64 - 8 * shift)) == 0
        found[alive[part]] += leading
        alive = alive[same]
        found[alive] += 8
    return np.minimum(found, depth)


def repeated_windows(contexts: list[np.ndarray], counts: np.ndarray, docs: np.ndarray, length: int):
    """(context, offset) of the windows that also start in a context of a smaller document."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    text = np.zeros(int(sizes.sum()) + len(sizes), np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    text[ragged(first, sizes)] = np.concatenate(contexts) + np.uint8(1)  # 0 stays for the ends; UTF-8 has no byte 255
    order = two_stage_suffix_array(text, length)
    group = np.cumsum(common_prefixes(text, order, length) < length)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)[order]
    offset = order - first[owner]
    valid = offset < counts[owner]
    group, owner, offset = group[valid], owner[valid], offset[valid]
    if not len(group):
        return owner, offset
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(docs[owner], starts), np.diff(np.r_[starts, len(group)]))
    gone = docs[owner] > least
    return owner[gone], offset[gone]


# Packed rows --------------------------------------------------------------------------------------------------------

def squeeze(entries: np.ndarray) -> bytes:
    """Entries byte plane by byte plane: places and counts of neighbours are alike, so these planes shrink."""
    planes = entries.view(np.uint8).reshape(len(entries), ENTRY.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unsqueeze(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(ENTRY.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(ENTRY).reshape(-1)


def packed_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_rows(packed: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packed])


# Contexts of documents ----------------------------------------------------------------------------------------------

def contexts_of(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text, start in its text, windows, hash of the picked substring, hash of the context) of every context."""
    n = len(data)
    gram = min(GRAM, max(1, length // 2))
    window = length - gram + 1
    windows = n - length + 1
    if windows <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    values = BYTE_VALUES[data]
    parts, size = [(values, 1)], 1
    while size * 2 <= gram:
        x = parts[-1][0]
        parts.append((x[:-size] + np.uint64(pow(BASE, size, 1 << 64)) * x[size:], 2 * size))
        size *= 2
    hashes, covered = None, 0
    for x, size in reversed(parts):
        if gram - covered >= size:
            if hashes is None:
                hashes = x
            else:
                rest = x[covered:]
                hashes = hashes[:len(rest)] + np.uint64(pow(BASE, covered, 1 << 64)) * rest[:len(hashes)]
            covered += size
    hashes = mix(hashes)
    bits = np.uint64(max(20, n.bit_length()))
    least = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[:len(least) - (window - width)], least[window - width:])
    picked = (least[:windows] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    valid = np.arange(windows) + length <= offsets[text + 1]
    new = valid.copy()
    new[1:] &= (picked[1:] != picked[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    counts = np.add.reduceat(valid.astype(np.int64), start)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(n))])
    back = np.full(n, np.uint64(INVERSE))
    back[0] = np.uint64(1)
    np.multiply.accumulate(back, out=back)
    whole = mix((sums[start + counts + length - 1] - sums[start]) * back[start] + counts.astype(np.uint64))
    return text[start], start - offsets[text[start]], counts, hashes[picked[start]], whole


def pack_marks(doc, key, group, start, count) -> np.ndarray:
    out = np.empty(len(doc), MARK)
    out["doc"], out["key"], out["group"], out["start"], out["count"] = doc, key, group, start, count
    return out


def dealt(marks: np.ndarray, groups: int) -> tuple[list[int], list[bytes]]:
    """Marks by the group of their document."""
    to = (mix(marks["doc"].astype(np.uint64) ^ mix(marks["key"].astype(np.uint64))) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    marks, to = marks[order], to[order]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    return to[cuts].tolist(), [marks[a:b].tobytes() for a, b in zip(cuts, np.r_[cuts[1:], len(to)])]


def group_of(ids: np.ndarray, keys: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) ^ mix(keys.astype(np.uint64))) % np.uint64(groups)).astype(np.int64)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NOBODY).to_numpy(zero_copy_only=False).astype(np.int64)


def remove_repeats(documents: DataFrame, length: int = 50, keep_text: bool = True, part_bytes: int = 8 << 20,
                   group_bytes: int = 4 << 20) -> DataFrame:
    """The documents with the repeated bytes taken out of ``text`` (without ``keep_text`` null instead), and n_bytes, n_removed, n_spans, kept_sha256 (of the
    remaining bytes). Characters that lose some of their bytes go from ``text`` as a whole. n_chars follows the text.

    Strings are judged on the input; matches never cross documents, nor count inside one document. A null text is empty
    and stays null; texts below ``length`` bytes stay. Rows with one doc_id do not remove from each other, and repeated
    rows are treated alike. A null id counts as larger than all others: such rows lose what others have, and take
    nothing from each other. Further columns pass through. An empty table gives no rows.
    """
    if length < 8:
        raise ValueError("strings of 8 bytes or more")
    columns = [c for c in documents.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]
    rows = documents.select(*columns, F.xxhash64("text").alias("_rr_key"))
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, groups = max(1, math.ceil(total / part_bytes)), max(1, math.ceil(total / group_bytes))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = utf8(whole.column("text"))[1] + 256 * np.arange(whole.num_rows + 1)  # at most 32768 rows at once
            for low, high in blocks(sizes, 8 << 20):
                batch = whole.slice(low, high - low)
                ids, keys = ids_of(batch.column("doc_id")), batch.column("_rr_key").to_numpy()
                data, offsets = utf8(batch.column("text"))
                found = []
                for a, b in blocks(offsets, 1 << 17):
                    text, start, count, gram, context = contexts_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], length)
                    made = np.empty(len(text), ENTRY)
                    part = (gram % np.uint64(parts)).astype(np.int32)
                    made["gram"] = (gram // np.uint64(parts)) & np.uint64(0xFFFFFFFF)
                    made["context"], made["more"] = context & np.uint64(0xFFFFFFFF), context >> np.uint64(48)
                    made["doc"], made["start"], made["count"] = a + text, start, count
                    found.append((part, made))
                part = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int32)
                order = np.argsort(part, kind="stable")
                made = np.concatenate([m for _, m in found])[order] if found else np.zeros(0, ENTRY)
                part = part[order]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
                packed, names = [], []
                for a, b in zip(cuts, np.r_[cuts[1:], len(part)]):
                    own = made[a:b].copy()
                    used, own["doc"] = np.unique(own["doc"], return_inverse=True)
                    packed.append(squeeze(own))
                    names.append(np.stack([ids[used], keys[used]]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cuts], pa.int32()), pa.array(packed, pa.binary()), pa.array(names, pa.binary())],
                    names=["part", "entries", "docs"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        """Marks of one part: contexts that a smaller document has whole (group -1), and contexts to be compared."""
        all_, ids, keys = [], [], []
        for packed, names in zip(table.column("entries").to_pylist(), table.column("docs").to_pylist()):
            own = unsqueeze(packed)
            pair = np.frombuffer(names, np.int64).reshape(2, -1)
            all_.append(own)
            ids.append(pair[0][own["doc"]])
            keys.append(pair[1][own["doc"]])
        own, ids, keys = np.concatenate(all_), np.concatenate(ids), np.concatenate(keys)
        order = np.lexsort((ids, own["more"], own["context"], own["gram"]))
        own, ids, keys = own[order], ids[order], keys[order]
        new_gram = np.r_[True, own["gram"][1:] != own["gram"][:-1]]
        new_context = new_gram | np.r_[True, (own["context"][1:] != own["context"][:-1]) | (own["more"][1:] != own["more"][:-1])]
        at_context, at_gram = np.flatnonzero(new_context), np.flatnonzero(new_gram)
        least = ids[at_context][np.cumsum(new_context) - 1]
        gram = np.cumsum(new_gram) - 1
        low, high = np.minimum.reduceat(ids, at_gram)[gram], np.maximum.reduceat(ids, at_gram)[gram]
        kinds = np.add.reduceat(new_context.astype(np.int64), at_gram)[gram]
        gone = ids > least
        ask = ~gone & (kinds > 1) & (low < high)
        part = key[0].as_py() if hasattr(key[0], "as_py") else int(key[0])
        group = np.where(gone, -1, (np.int64(part) << 32) | own["gram"].astype(np.int64))
        keep = gone | ask
        to, packed = dealt(pack_marks(ids[keep], keys[keep], group[keep], own["start"][keep], own["count"][keep]), groups)
        return pa.table({"_rr_to": pa.array(to, pa.int64()), "marks": pa.array(packed, pa.binary())})

    marks = (rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_rr_key", "text")
             .mapInArrow(entries, "part int, entries binary, docs binary")
             .groupBy("part").applyInArrow(meet, "_rr_to long, marks binary"))

    def by_group(frame: DataFrame, n: int):
        """The rows, packed, by the group of their document."""
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                to = group_of(ids_of(b.column("doc_id").cast(pa.int64())), b.column("_rr_key").to_numpy(), n)
                order = np.argsort(to, kind="stable")
                b, to = b.take(pa.array(order)), to[order]
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
                rows = [packed_rows(b.slice(x, y - x)) for x, y in zip(cuts, np.r_[cuts[1:], len(to)])]
                yield pa.RecordBatch.from_arrays([pa.array(to[cuts], pa.int64()), pa.array(rows, pa.binary())], names=["_rr_to", "rows"])

        return frame.mapInArrow(add, "_rr_to long, rows binary").groupBy("_rr_to")

    digest = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, _rr_gone binary, _rr_asked binary").fields])
    has_chars = "n_chars" in columns

    def settle(last: bool):
        """Apply a group's marks to its documents. Documents with contexts still to compare wait, unless it is the last
        step: their text stays, with what is gone so far."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({f.name: pa.array([], f.type) for f in to_arrow_schema(schema)})
            left = unpacked_rows(left.column("rows").to_pylist())
            ids, keys = ids_of(left.column("doc_id").cast(pa.int64()).combine_chunks()), left.column("_rr_key").to_numpy()
            data, offsets = utf8(left.column("text"))
            found = np.concatenate([np.zeros(0, MARK), *(np.frombuffer(m, MARK) for m in right.column("marks").to_pylist())])
            found = found[np.lexsort((found["key"], found["doc"]))]
            names = np.rec.fromarrays([found["doc"], found["key"]], names="a,b") if len(found) else None
            begin = np.flatnonzero(np.r_[True, (found["doc"][1:] != found["doc"][:-1]) | (found["key"][1:] != found["key"][:-1])]) \
                if len(found) else np.zeros(0, np.int64)
            spans = {(int(names.a[i]), int(names.b[i])): (i, j) for i, j in zip(begin, np.r_[begin[1:], len(found)])}
            texts, gone_, asked_, figures = left.column("text").to_pylist(), [], [], []
            before = left.column("_rr_gone").to_pylist() if "_rr_gone" in left.column_names else [None] * len(ids)
            for i, text in enumerate(texts):
                a, b = spans.get((int(ids[i]), int(keys[i])), (0, 0))
                own = found[a:b]
                gone = own[own["group"] < 0]
                if before[i]:
                    gone = np.concatenate([gone, np.frombuffer(before[i], MARK)])
                asked = own[own["group"] >= 0]
                raw = data[offsets[i]:offsets[i + 1]]
                if len(asked) and not last:
                    gone_.append(gone.tobytes())
                    asked_.append(asked.tobytes())
                    figures.append((len(raw), None, None, None))
                    continue
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, gone["start"].astype(np.int64), 1)
                np.add.at(change, gone["start"].astype(np.int64) + gone["count"] + length - 1, -1)
                cover = np.cumsum(change[:-1]) > 0
                kept = raw[~cover].tobytes()
                spans_here = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
                figures.append((len(raw), int(cover.sum()), spans_here, hashlib.sha256(kept).hexdigest()))
                if spans_here:
                    texts[i] = kept.decode("utf-8", "ignore")
                gone_.append(None)
                asked_.append(None)
            out = {c: left.column(c) for c in [*columns, "_rr_key"]}
            if has_chars:
                changed = np.array([bool(f[2]) for f in figures], bool)
                sizes = pa.array([len(t) if t is not None else 0 for t in texts], left.schema.field("n_chars").type)
                out["n_chars"] = pc.if_else(pa.array(changed), sizes, left.column("n_chars").combine_chunks())
            if not keep_text:
                texts = [text if wait is not None else None for text, wait in zip(texts, asked_)]
            out["text"] = pa.array(texts, left.schema.field("text").type)
            for (name, kind), values in zip(digest, zip(*figures) if figures else [[]] * 4):
                out[name] = pa.array(values, kind)
            out["_rr_gone"], out["_rr_asked"] = pa.array(gone_, pa.binary()), pa.array(asked_, pa.binary())
            return pa.table(out)

        return run

    step = staged(by_group(rows, groups).cogroup(marks.groupBy("_rr_to")).applyInArrow(settle(False), schema), "settled")
    waiting = step.where("_rr_asked is not null")
    asked = waiting.agg(F.sum(F.length("_rr_asked"))).first()[0] or 0
    result = step.where("_rr_asked is null").select(*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    if not asked:
        return result
    compares = max(1, math.ceil(asked / MARK.itemsize * (length + 25) / (1 << 20)))
    later = max(1, math.ceil((waiting.agg(F.sum("n_bytes")).first()[0] or 0) / group_bytes))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts to compare, as bytes, by the group of their substring."""
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            asked = [np.frombuffer(m, MARK) for m in batch.column("_rr_asked").to_pylist()]
            if not asked:
                continue
            own = np.concatenate(asked)
            base = np.repeat(offsets[:-1], [len(m) for m in asked]) + own["start"]
            to = (mix(own["group"].astype(np.uint64)) % np.uint64(compares)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            own, base, to = own[order], base[order], to[order]
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            ends = np.r_[cuts[1:], len(to)]
            texts = [data[ragged(base[a:b], own["count"][a:b].astype(np.int64) + length - 1)].tobytes() for a, b in zip(cuts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[cuts], pa.int64()), pa.array([own[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                 pa.array(texts, pa.binary())], names=["part", "marks", "texts"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        own = np.concatenate([np.frombuffer(m, MARK) for m in table.column("marks").to_pylist()])
        data = np.concatenate([np.frombuffer(t, np.uint8) for t in table.column("texts").to_pylist()])
        sizes = own["count"].astype(np.int64) + length - 1
        contexts = np.split(data, np.cumsum(sizes)[:-1])
        owner, offset = repeated_windows(contexts, own["count"].astype(np.int64), own["doc"], length)
        order = np.lexsort((offset, owner))
        owner, offset = owner[order], offset[order]
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(owner) else owner
        counts = np.diff(np.r_[new, len(owner)])
        owner, offset = owner[new], offset[new]
        to, packed = dealt(pack_marks(own["doc"][owner], own["key"][owner], -1, own["start"][owner] + offset, counts), later)
        return pa.table({"_rr_to": pa.array(to, pa.int64()), "marks": pa.array(packed, pa.binary())})

    found = (waiting.select("text", "_rr_asked").mapInArrow(fetch, "part long, marks binary, texts binary")
             .groupBy("part").applyInArrow(compare, "_rr_to long, marks binary"))
    rest = waiting.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "_rr_asked")
    done = by_group(rest, later).cogroup(found.groupBy("_rr_to")).applyInArrow(settle(True), schema)
    return result.unionByName(done.select(result.columns))
