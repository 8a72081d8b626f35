import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tandem.llm import packing

from .conftest import words


def plain_first_fit(sizes, room):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((k for k, used in enumerate(bins) if used + sizes[i] <= room), None)
        if at is None:
            at = len(bins)
            bins.append(0)
        out[i] = (at, bins[at])
        bins[at] += sizes[i]
    return out


def test_first_fit_by_tournament_tree():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 70))]
        assert packing.first_fit_decreasing(sizes, 100) == plain_first_fit(sizes, 100)


TEXTS = [None, "", " ", "Hello world", "it's 2024\n\n  ok\t", "é ñ ß œ Ω 中文 😀", "<|endoftext|> inside", "  x ", "a" * 30_000, "\x00\x1c\x85", "١٢٣ ²³ Ⅷ"]


def test_ids_are_the_tokenizers(spark):
    rng = random.Random(3)
    full = Tokenizer.from_file(packing.TOKENIZER)
    latin = [chr(c) for c in range(1, 256)]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(latin) for _ in range(200)) for _ in range(200)] + ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(50)) for _ in range(100)]
    for t in texts:
        assert packing.encode(t) == full.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("with_ids", [True, False])
def test_every_id_lies_in_one_piece(spark, docs, monkeypatch, with_ids):
    monkeypatch.setattr(packing, "GROUP_DOCS", 40)
    rng = random.Random(4)
    rows = list(enumerate(TEXTS)) + [(100 + i, words(rng, rng.randint(1, 900))) for i in range(150)] + [(None, "no id"), (100, "again"), (100, "again")]
    frame = docs(rows).withColumn("grp", F.lit("clash")).withColumn("offset", F.lit(1)).withColumn("length", F.lit(2))
    got = [r.asDict() for r in packing.pack(frame, with_ids).collect()]
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*packing.encode(t or ""), 0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for i, lists in ids.items():
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[i]) == sorted((a, len(x[a : a + 1024]), zlib.crc32(np.array(x[a : a + 1024], "<u4").tobytes()), len(x)) for x in lists for a in range(0, len(x), 1024))
        if with_ids and len(lists) == 1:
            assert [t for r in sorted(by_doc[i], key=lambda r: r["start"]) for t in r["ids"]] == lists[0]
    used = 0
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
        used += at
    assert used == sum(len(x) for lists in ids.values() for x in lists)
    assert len(by_seq) * 1024 < 1.08 * used


def test_empty_table(spark, docs):
    assert packing.pack(docs([])).count() == 0


def test_query_has_little_padding(spark):
    got = packing.op6_packing(spark, "/root/testdata/sf0.01")
    used, sequences = got.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert sequences * 1024 < 1.01 * used


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "\t \n" * 100_000 + "x", "1.5,2\n" * 30_000, "你好。世界" * 20_000, "<|endoftext|> a" * 9000, "don't. we'll 'sa。" * 9000])
def test_very_long_texts_get_the_tokenizers_ids(text):
    began = time.perf_counter()
    got = packing.encode(text)
    assert time.perf_counter() - began < 30
    assert got == Tokenizer.from_file(packing.TOKENIZER).encode(text, add_special_tokens=False).ids


def test_parts_are_cut_where_no_token_goes_over(monkeypatch):
    monkeypatch.setattr(packing, "PART", 20)
    rng, full = random.Random(6), Tokenizer.from_file(packing.TOKENIZER)
    for _ in range(300):
        t = "".join(rng.choice(" \n\t ab1.,'_é中。：\x1c\x85\xa0st") for _ in range(rng.randint(0, 400)))
        assert "".join(packing._parts(t)) == t
        assert packing.encode(t) == full.encode(t, add_special_tokens=False).ids


def test_long_blank_documents_are_packed(spark, docs):
    got = packing.pack(docs([(1, " " * 1_000_000), (2, "short")]), with_ids=False)
    assert got.where("doc_id = 1").agg(F.sum("length")).first()[0] == len(packing.encode(" " * 1_000_000)) + 1


def test_query_against_plain_version(spark):
    path, full = "/root/testdata/sf0.001", Tokenizer.from_file(packing.TOKENIZER)
    want = {r["doc_id"]: [*full.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    pieces, places, rest = defaultdict(list), defaultdict(list), []
    for r in packing.op6_packing(spark, path).collect():
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"], r["ids_crc32"]))
        if r["length"] < 1024:
            rest.append((-r["length"], r["doc_id"], r["ids_crc32"], r["sequence_id"], r["offset"]))
    for i, ids in want.items():
        assert sorted(pieces[i]) == [(a, min(1024, len(ids) - a)) for a in range(0, len(ids), 1024)]
    for inside in places.values():
        at = 0
        for offset, length, *_ in sorted(inside):
            assert offset == at
            at += length
    # One group here: its bins are those of plain first fit over the left-overs, longest first.
    rest.sort()
    plain = plain_first_fit([-n for n, *_ in rest], 1024)
    bins = {}
    for (_, _, _, sequence, offset), (at, used) in zip(rest, plain):
        assert bins.setdefault(at, sequence) == sequence and offset == used
