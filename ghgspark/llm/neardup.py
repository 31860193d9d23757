"""Near-duplicate documents by HyperMinHash.

Every text is the set of its word shingles. Each shingle's hash picks one of 128 registers; a register keeps the count
of leading zeros and ten mantissa bits of its smallest hash. Four registers make a band, and texts with an equal band
are candidates. A candidate pair is estimated (corrected for chance collisions of registers) and then verified on the
full sets. Texts with one set are one class; only classes meet.

In a band's bucket not all pairs are made. Each member first meets the bucket's hub, the member that shares buckets with
the most others. Members that this leaves outside their hub's component then meet, in tasks of bounded size, all members
that share a bucket with that hub: the sizes of all intersections are counted inside the task, and links alone leave it.
So each candidate pair is verified or already inside one component, and components come out as if all had been verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ghgspark.llm.common import BYTE_VALUES, blocks, mix, powers, ragged, staged, utf8

REGISTERS, MANTISSA, BAND = 128, 10, 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_VALUES = np.where(_WHITE, np.uint64(0), BYTE_VALUES[_LOWER])
_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted. Words are runs without white space, A-Z in lower case; a text of
    fewer words is one shingle of all of them, a text without words has none."""
    white = _WHITE[data]
    start = ~white
    start[1:] &= white[:-1]
    inner = offsets[(offsets < len(data)) & (offsets >= 0)]
    start[inner] = ~white[inner]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    span = np.diff(at, append=len(data))
    place = np.arange(len(data) - at[0], dtype=np.int32) - np.repeat((at - at[0]).astype(np.int32), span)
    words = mix(np.add.reduceat(_VALUES[data[at[0]:]] * powers(int(span.max()))[place], at - at[0])
                + np.add.reduceat((~white[at[0]:]).astype(np.uint64), at - at[0]))
    text = np.searchsorted(offsets, at, "right") - 1
    first = np.r_[True, text[1:] != text[:-1]]
    total = np.zeros(len(words), np.uint64)
    reach = np.zeros(len(words), np.int64)
    for k in range(width):
        same = np.zeros(len(words), bool)
        same[:len(words) - k] = text[k:] == text[:len(words) - k]
        total[:len(words) - k] += np.where(same[:len(words) - k], words[k:] * _STEPS[k % 64], np.uint64(0))
        reach += same
    keep = (reach == width) | first
    text, total = text[keep], mix(total[keep] + reach[keep].astype(np.uint64))
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (total[1:] != total[:-1])]
    return text[new], total[new]


def signatures(text: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """Registers (uint16, 0: empty) of every text; a smaller hash gives a larger register."""
    out = np.zeros((texts, REGISTERS), np.uint16)
    register = (hashes >> np.uint64(64 - 7)).astype(np.int64)
    if len(hashes):
        least = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (register[1:] != register[:-1])])
        rest = hashes[least] << np.uint64(7)
        zeros = np.where(rest == 0, 57, 64 - np.frexp(rest.astype(np.float64))[1]).clip(0, 57).astype(np.uint64)
        mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        value = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | (np.uint64((1 << MANTISSA) - 1) - mantissa)
        out[text[least], register[least]] = value
    return out


def describe(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, two sums that name the set, and the bands (4 registers in a long each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            columns = [[] for _ in range(4)]
            for low, high in blocks(offsets, 1 << 20):
                text, hashes = shingles(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], width)
                counts = np.bincount(text, minlength=high - low)
                ends = np.concatenate([[0], np.cumsum(counts)])
                columns[0].append(counts)
                for k, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)))])
                    columns[k].append(sums[ends[1:]] - sums[ends[:-1]])
                columns[3].append(signatures(text, hashes, high - low).view(np.int64).reshape(-1))
            counts, one, two, bands = (np.concatenate([np.zeros(0, np.int64), *(c.view(np.int64) for c in parts)])
                                       for parts in columns)
            per = REGISTERS // BAND
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(counts), pa.array(one), pa.array(two),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, per, dtype=np.int32)), pa.array(bands))],
                names=["doc_id", "text_key", "n_shingles", "one", "two", "bands"])

    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, one long, two long, bands array<long>")


def estimate(a: str, b: str, n: str, m: str) -> str:
    """Jaccard estimate of two signatures: the share of equal registers, less the expected chance collisions."""
    def lanes(test: str) -> str:
        return " + ".join(f"int({test.format(k=16 * k)})" for k in range(4))

    equal = lanes("shiftright(x ^ y, {k}) & 65535L = 0 and shiftright(x, {k}) & 65535L <> 0")
    used = lanes("shiftright(x | y, {k}) & 65535L <> 0")
    both = f"zip_with({a}, {b}, (x, y) -> struct({equal} as e, {used} as u))"
    chance = f"(0.169919487159739D / {1 << MANTISSA} * 4D * {n} * {m} / pow({n} + {m}, 2))"
    return (f"aggregate({both}, struct(0 as e, 0 as u), (s, r) -> struct(s.e + r.e as e, s.u + r.u as u), "
            f"s -> struct((s.e / s.u - {chance}) / (1 - {chance}) as j, s.u as used))")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, a_key, b, b_key) whose full sets have 100 |intersection| >= percent |union|."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = utf8(batch.column("a_text")), utf8(batch.column("b_text"))
            keep = np.zeros(batch.num_rows, bool)
            for low, high in blocks(left[1] + right[1], 1 << 20):
                sets = [shingles(d[o[low]:o[high]], o[low:high + 1] - o[low], width) for d, o in (left, right)]
                sizes = sum(np.bincount(t, minlength=high - low) for t, _ in sets)
                text, value = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
                order = np.lexsort((value, text))
                text, value = text[order], value[order]
                twice = (text[1:] == text[:-1]) & (value[1:] == value[:-1])
                common = np.bincount(text[1:][twice], minlength=high - low)
                keep[low:high] = (100 * common >= percent * (sizes - common)) & (common > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["u", "v"])

    def side(name: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(name), F.col("text_key").alias(f"{name}_key"), F.col("text").alias(f"{name}_text"))

    both = pairs.select("a", "a_key", "b", "b_key").join(side("a"), ["a", "a_key"]).join(side("b"), ["b", "b_key"])
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "u long, v long")


def close(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: np.ndarray, columns: np.ndarray,
          percent: int, at_once: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left set, right set) with 100 |intersection| >= percent |union|, of all left and right sets, both given as
    (set, value) with distinct pairs; ``rows`` and ``columns`` are the sizes of the sets.

    Left sets go through in chunks, so that no array has many more than ``at_once`` cells, or one row of them.
    """
    order = np.argsort(right[1], kind="stable")
    sets_r, values_r = right[0][order], right[1][order]
    order = np.argsort(left[0], kind="stable")
    sets_l, values_l = left[0][order], left[1][order]
    step = max(1, at_once // max(1, len(columns)))
    for first in range(0, len(rows), step):
        sizes = rows[first:first + step]
        cells = len(sizes) * len(columns)
        own = slice(*np.searchsorted(sets_l, [first, first + len(sizes)]))
        low, high = (np.searchsorted(values_r, values_l[own], side) for side in ("left", "right"))
        n = high - low
        met = np.cumsum(n)
        both, start = np.zeros(cells, np.int64), 0
        while start < len(n):
            before = met[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(met, before + at_once, "right")))
            some = n[start:end]
            pairs = np.repeat((sets_l[own][start:end] - first) * len(columns), some) + sets_r[ragged(low[start:end], some)]
            both += np.bincount(pairs, minlength=cells)
            start = end
        both = both.reshape(len(sizes), len(columns))
        x, y = np.nonzero(100 * both >= percent * (sizes[:, None] + columns[None, :] - both))
        yield x + first, y


def outside_links(pairs: DataFrame, placed: DataFrame, classes: DataFrame, sources: DataFrame, width: int, percent: int,
                  outside_size: int = 1 << 18, member_size: int = 1 << 20,
                  outside_texts: int = 1 << 13, member_texts: int = 1 << 15) -> DataFrame:
    """u, v: a link to every component that a text outside its hub's component reaches among the hub's neighbours.

    ``pairs`` (a, a_key, b, b_key) names texts and hubs, ``placed`` (id, component) the components so far. A hub's
    outside texts and its neighbours are dealt into blocks of about so many shingles and texts at most; every block of the
    ones meets every block of the others.
    """
    sizes = classes.select("id", "key", F.col("n_shingles").alias("n"))
    hub = pairs.selectExpr("b as hub", "b_key as hub_key", "a as id", "a_key as key")
    known = hub.unionByName(hub.selectExpr("hub", "hub_key", "hub as id", "hub_key as key").distinct())
    rows = (
        known.join(sizes, ["id", "key"]).join(placed, "id", "left")
        .join(placed.selectExpr("id as hub", "component as hub_component"), "hub", "left")
        .selectExpr("hub", "hub_key", "id", "key", "n", "coalesce(component, id) as component",
                    "coalesce(component, id) <> coalesce(hub_component, hub) as outside")
    )
    # Hubs with something outside, beside a pair that has met already.
    groups = rows.groupBy("hub", "hub_key").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("outside"), F.col("n"))).alias("out"), F.count("*").alias("members"),
        F.count_if("outside").alias("outsiders"),
    ).where("out > 0 and members > 2").selectExpr(
        "hub", "hub_key", f"int(ceil(greatest(out / {outside_size}, outsiders / {outside_texts}))) as outs",
        f"int(ceil(greatest(total / {member_size}, members / {member_texts}))) as parts")
    own = "int(pmod(xxhash64(id, key), {}))"
    places = (f"concat(transform(sequence(0, outs - 1), i -> struct(i as i, {own.format('parts')} as j, "
              f"if(outside and i = {own.format('outs')}, 3, 1) as role)), "
              f"if(outside, transform(filter(sequence(0, parts - 1), j -> j <> {own.format('parts')}), "
              f"j -> struct({own.format('outs')} as i, j as j, 2 as role)), array()))")
    dealt = staged(rows.join(groups, ["hub", "hub_key"]).select(
        "hub", "hub_key", "id", "key", "n", "component", F.explode(F.expr(places)).alias("to")).selectExpr(
        "xxhash64(hub, hub_key, to.i, to.j) as meeting", "id", "key", "n", "component", "to.role as role"), "meetings")
    size, dealt_texts = dealt.agg(F.sum("n"), F.count("*")).first()
    tasks = max(1, math.ceil(max((size or 0) / member_size, dealt_texts / member_texts)))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("meeting", "ascending"), ("id", "ascending")])
        meeting, ids, component, role = (table.column(c).to_numpy() for c in ("meeting", "id", "component", "role"))
        data, offsets = utf8(table.column("text"))
        sets = [(low + t, v) for low, high in blocks(offsets, 1 << 20)
                for t, v in [shingles(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], width)]]
        owner, value = (np.concatenate(x) for x in zip(*sets))
        counts = np.bincount(owner, minlength=len(ids))
        ends = np.concatenate([[0], np.cumsum(counts)])
        found = [np.zeros((2, 0), np.int64)]
        cuts = np.flatnonzero(np.r_[True, meeting[1:] != meeting[:-1], True])
        for low, high in zip(cuts, cuts[1:]):
            rows_of = [low + np.flatnonzero(role[low:high] & bit) for bit in (2, 1)]
            if not all(map(len, rows_of)):
                continue
            number = [np.full(high - low, -1) for _ in rows_of]
            pieces = []
            for k, own_rows in enumerate(rows_of):
                number[k][own_rows - low] = np.arange(len(own_rows))
                at = ragged(ends[own_rows], counts[own_rows])
                pieces.append((number[k][owner[at] - low], value[at]))
            for x, y in close(*pieces, *(counts[r] for r in rows_of), percent):
                x, y = rows_of[0][x], rows_of[1][y]
                apart = component[x] != component[y]
                x, y = x[apart], y[apart]
                if len(x):
                    _, once = np.unique(np.stack([ids[x], component[y]]), axis=1, return_index=True)
                    found.append(np.stack([ids[x[once]], ids[y[once]]]))
        u, v = np.concatenate(found, axis=1)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    texts = sources.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "text")
    return (
        dealt.join(texts, ["id", "key"]).select(
            F.pmod("meeting", F.lit(tasks)).alias("part"), "meeting", "id", "component", "role", "text")
        .groupBy("part").applyInArrow(meet, "u long, v long")
    )


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that links reach) of every linked node.

    Large and small stars in turn until nothing changes. Minima combine before the shuffle, so a node with very many
    links does not gather them in one task; each round starts from files.
    """
    def nearest(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    links = links.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct()
    links, seen = staged(links, "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
        around = links.unionByName(links.selectExpr("v as u", "u as v"))
        large = around.join(nearest(around), "u").where("v > u").selectExpr("v as u", "m as v").distinct()
        # Now u > v: the small star links a node's smaller neighbours, and itself, to the smallest of them.
        least = nearest(large)
        small = large.join(least, "u").where("v <> m").selectExpr("v as u", "m as v").unionByName(
            least.selectExpr("u", "m as v")).distinct()
        links = staged(small, "links")


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept.

    Two texts are linked if 100 |intersection| >= percent |union| of their shingles (``width`` words). Texts without
    words, null ones too, are linked with nothing. Rows of one doc_id are one document: a link of either counts for
    both. A null doc_id takes no part in links: its component is null and it is kept. An empty table gives no rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = staged(describe(texts, width), "described")
    classes = staged(
        described.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "one", "two")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.any_value("bands").alias("bands"))
        .select("n_shingles", "one", "two", F.col("rep.doc_id").alias("id"), F.col("rep.text_key").alias("key"), "bands"),
        "classes")
    members = described.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "one", "two").join(
        classes.select("n_shingles", "one", "two", "id"), ["n_shingles", "one", "two"]).select("doc_id", "id")
    same_id = members.where("doc_id <> id").selectExpr("doc_id as u", "id as v")

    banded = classes.select("id", "key", F.posexplode("bands")).where("col <> 0").select(
        "id", "key", F.xxhash64("pos", "col").alias("band"))
    crowds = banded.groupBy("band").count().where("count > 1").withColumnRenamed("count", "crowd")
    shared = staged(banded.join(crowds, "band"), "shared")
    degree = shared.groupBy("id", "key").agg(F.sum("crowd").alias("degree"))
    drawn = staged(shared.join(degree, ["id", "key"]).select("band", "id", "key", "degree"), "drawn")
    hubs = drawn.groupBy("band").agg(F.max_by(F.struct("id", "key"), F.struct("degree", -F.col("id"), "key")).alias("hub"))
    wanted = degree.select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"))
    sources = staged(texts.withColumn("text_key", F.xxhash64("text")).join(wanted, ["doc_id", "text_key"])
                     .dropDuplicates(["doc_id", "text_key"]), "sources")

    def check(pairs: DataFrame) -> DataFrame:
        """Links among the pairs: sizes and estimates first, then the full sets."""
        def side(name: str) -> DataFrame:
            return classes.selectExpr(f"id as {name}", f"key as {name}_key", f"n_shingles as {name}_n", f"bands as {name}_bands")

        estimated = pairs.join(side("a"), ["a", "a_key"]).join(side("b"), ["b", "b_key"]).where(
            f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
        ).withColumn("e", F.expr(estimate("a_bands", "b_bands", "a_n", "b_n"))).where(
            f"e.j >= {percent / 100} - 5 * sqrt({percent / 100 * (1 - percent / 100)} / e.used)")
        return verified(estimated, sources, width, percent)

    to_hub = staged(drawn.join(hubs, "band").where("id <> hub.id or key <> hub.key").selectExpr(
        "id as a", "key as a_key", "hub.id as b", "hub.key as b_key").distinct(), "pairs")
    links = staged(check(to_hub), "checked")
    first = staged(components(links), "components").selectExpr("node as id", "component")
    more = staged(outside_links(to_hub, first, classes, sources, width, percent), "more")
    found = components(links.unionByName(more).unionByName(same_id))
    return described.join(found, F.col("doc_id") == F.col("node"), "left").selectExpr(
        "doc_id", "n_shingles", "coalesce(component, doc_id) as component_id",
        "coalesce(doc_id = coalesce(component, doc_id), true) as kept")
