"""Packing, licences, byte-level BPE and secrets against plain versions of themselves."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from ghgspark.llm import bpe, licenses, packing, secrets
from ghgspark.llm.queries import op7_secret_scan

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["it's 's ''s don't  we'll\n\n x \n y  \t z ", "", " ", "\n", "a  ", "a \n b", "x×y÷z \x1c a\x85b\xa0c",
       "<|endoftext|> a<|endoftext|>", "日本語 text", "a" * 3000, "..." * 50 + " ,,;"]


def plain_bfd(sizes, capacity):
    bins = []
    for size in sorted(sizes, reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= size]
        if fit:
            bins[min(fit, key=bins.__getitem__)] -= size
        else:
            bins.append(capacity - size)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    draw = random.Random(1)
    for _ in range(150):
        capacity = draw.choice([7, 20, 64])
        sizes = [draw.randint(1, capacity) for _ in range(draw.randint(0, 120))]
        plan = packing.best_fit_decreasing({s: sizes.count(s) for s in set(sizes)}, capacity)
        used = {}
        for size in set(sizes):
            n = sizes.count(size)
            for b, at in zip(*(x.tolist() for x in plan.place(np.full(n, size), np.arange(n)))):
                used.setdefault(b, []).append((at, size))
        for places in used.values():
            end = 0
            for at, size in sorted(places):
                assert at == end
                end += size
        assert sorted(capacity - sum(s for _, s in places) for places in used.values()) == plain_bfd(sizes, capacity)
        assert plan.bins == len(used)


def test_packing_of_messy_documents(messy, nothing):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    rows = packing.pack_documents(messy, JSON, 64).collect()
    wanted = []
    for doc in messy.collect():
        ids = tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids + [0]
        head = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(head, len(ids) + 1, 64)]
        wanted += [(doc["doc_id"], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                   for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key)
    assert got == sorted(wanted, key=key)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for at, size in sorted(own):
            assert at == end
            end += size
        assert end <= 64
    assert len(places) == len(plain_bfd([r["length"] for r in rows], 64))
    assert packing.pack_documents(nothing, JSON).count() == 0


def test_bpe_equals_the_library(spark, messy, nothing):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    frame = messy.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"]))
           for r in bpe.encode_decode(frame, RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()}
    wanted = set()
    for doc in frame.collect():
        text = doc["text"] or ""
        ids = encoding.encode_ordinary(text)
        wanted.add((doc["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(text.encode()).hexdigest(), tuple(ids)))
    assert got == wanted
    assert bpe.encode_decode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_random_code_points():
    draw = random.Random(5)
    ranks = bpe.load_ranks(RANKS)
    pairs, encoding = bpe.BytePairs(ranks), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _ in range(300):
        word = "".join(chr(draw.choice([draw.randint(97, 122), draw.randint(97, 122), draw.randint(0xC0, 0x24F)])) for _ in range(draw.randint(1, 30)))
        assert pairs.encode(word.encode()) == encoding.encode_ordinary(word)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_licenses(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i:i + len(own)] == own:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark, messy, nothing):
    texts = ["MIT License and mit-license, Apache\nLicense; Licensed under CC BY-NC 4.0.", "cc by cc by", "éMIT License", "GNU General Public License.",
             "x\n// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND Apache-2.0\ny",
             "permit license", "MIT\x00License", "SPDX-License-Identifier: OR OR"]
    frame = messy.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = licenses.scan_licenses(frame).collect()
    assert len(rows) == frame.count()
    plain = sorted((str(d["doc_id"]), *map(str, plain_licenses(d["text"] or ""))) for d in frame.collect())
    assert sorted((str(r["doc_id"]), *map(str, (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))) for r in rows) == plain
    by = {r["doc_id"]: r for r in rows}
    assert by[104]["labels"] == "apache,gpl,mit" and by[104]["base_labels"] == "" and by[104]["freedom"] == 1.0
    assert by[100]["labels"] == "apache,cc-by,cc-by-nc,mit" and by[107]["expressions"] == ""
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)
    assert licenses.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize("text, value", [
    ("MIT", (["mit"], 1.0)), ("GPL-2.0+ or MIT and CC-BY-NC-4.0", (["gpl", "mit", "cc-by-nc"], 0.3)),
    ("(GPL-3.0 OR MIT) AND BSD-2-Clause", (["gpl", "mit", "bsd"], 1.0)), ("LGPL-2.1 WITH x OR AGPL-3.0", (["lgpl", "agpl"], 0.5)),
    ("MIT OR", None), ("(MIT", None), ("MIT)", None), ("MIT MIT", None), ("", None), ("AND MIT", None),
])
def test_expressions(text, value):
    assert licenses.evaluate(text) == value


ASSIGN = re.compile(secrets.ASSIGN.replace("(?i:", "(?ai:"))


def plain_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secret_scan(spark, messy, nothing):
    draw = random.Random(2)
    parts = ["token", "passwd", "Password", "API_KEY", "apikey", "secret", " ", "=", ":", '"', "'", "AKIA" + "A1B2" * 4, "AKIAX", "0123456789abcdef" * 2,
             "abcd", "abcdefgh", "é🙂", "_.-", "word", "\n", "TOKEN=token:abcdefg"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(400)]
    frame = messy.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = secrets.scan_secrets(frame).collect()
    got = sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows)
    wanted = []
    for doc in frame.collect():
        spans = plain_spans(doc["text"] or "")
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        wanted.append((str(doc["doc_id"]), *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest()))
    assert got == sorted(wanted)
    assert secrets.scan_secrets(nothing).count() == 0 and secrets.redact(nothing).count() == 0


def test_random_strings_are_found_and_masked(spark):
    draw = random.Random(9)
    code = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    loose = "".join(draw.choice("0123456789ABCDEF") for _ in range(32))
    rows = [(i, f"some ordinary words and identifiers like counter_value_of_item2 token = {code(40)} end", 1) for i in range(200)]
    rows += [(900, f"before {loose} after", 46), (901, "a long_ordinary_identifier_with_number_2 stays", 46), (902, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(frame).collect()}
    assert spans[900] == "markov:7:39" and spans[901] == ""
    clean = {r["doc_id"]: r for r in secrets.redact(frame).collect()}
    assert clean[900]["text"] == "before [SECRET] after" and clean[900]["n_chars"] == len(clean[900]["text"])
    assert clean[901]["text"] == rows[-2][1] and clean[901]["n_chars"] == 46 and clean[902]["text"] is None
    assert clean[5]["text"] == "some ordinary words and identifiers like counter_value_of_item2 [SECRET] end"


def test_secret_query_covers_its_table(spark):
    sf = "/root/testdata/sf0.001"
    assert op7_secret_scan(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pretoken_cache_stays_small_and_right():
    """Every distinct pre-token is kept in some tens of bytes, and ids stay right when the cache is emptied."""
    import tracemalloc

    from ghgspark.llm.pretokens import PretokenIds

    text = "".join(" " + "".join(chr(97 + n // 26**k % 26) for k in range(5)) for n in range(100_000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.arange(0, len(text) + 1, 6000)

    def encode(words):
        return [list(w) for w in words]

    tracemalloc.start()
    try:
        cache = PretokenIds(r"\S+|\s+", encode, block=1 << 16)
        empty = tracemalloc.get_traced_memory()[0]
        ids = np.concatenate([ids for _, ids, _ in cache.texts(data, offsets)])
        taken = tracemalloc.get_traced_memory()[0] - empty - ids.nbytes
    finally:
        tracemalloc.stop()
    assert ids.tolist() == list(text)
    assert cache.count == 100_000 and taken < 100 * cache.count
    small = PretokenIds(r"\S+|\s+", encode, limit=50)
    for low in range(0, 40_000, 400):
        part = data[low:low + 400]
        assert [list(ids) for _, ids, _ in small.texts(part, np.array([0, 100, len(part)]))][0] == part.tolist()
