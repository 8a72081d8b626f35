import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tandem.llm import graph, simhash

from .conftest import words


def plain_simhash(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance=4):
    """Smallest doc_id reachable, for (doc_id, fp) rows."""
    parent = {i: i for i, _ in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in fps:
        for j, b in fps:
            if i < j and bin(a ^ b).count("1") <= distance:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in fps}


TEXTS = [None, "", " \t\n", "One", "one", "a b c", "A b\tC d e", "é É ß x y z", "a\x1cb c d e", "x y z q w", "w " * 5000]


def test_fingerprints_match_a_plain_version(spark, docs):
    rng = random.Random(4)
    texts = TEXTS + [words(rng, rng.randint(1, 400)) for _ in range(60)]
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(docs(list(enumerate(texts)))).collect()}
    assert got == {i: plain_simhash(t) for i, t in enumerate(texts)}


def test_spark_hashes_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def clump(rng, n, bits=24, flips=9):
    centre = rng.getrandbits(64)
    loose = rng.sample(range(64), bits)
    return {centre ^ sum(1 << b for b in rng.sample(loose, rng.randint(0, flips))) for _ in range(n)}


@pytest.mark.parametrize("split_over", [4096, 8])
def test_links_join_exactly_what_is_near(spark, split_over):
    rng = random.Random(7)
    fps = clump(rng, 400) | clump(rng, 150, 12, 12) | {rng.getrandbits(64) for _ in range(200)} | {0, 1, (1 << 64) - 1, 0b11111}
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(sorted(fps, key=lambda _: rng.random()))]
    points = spark.createDataFrame(rows, "ident long, fp long")
    found = {r["node"]: r["root"] for r in graph.components(simhash.links(points, split_over)).collect()}
    want = plain_components([(i, x & (1 << 64) - 1) for i, x in rows])
    assert {i: found.get(i, i) for i, _ in rows} == want


def test_the_index_prunes_and_finds_all(spark):
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 1 << 20, 700, dtype=np.uint64))
    x = x[np.argsort(simhash.gray_rank(x))]
    index = simhash.GrayIndex(x, np.array([0]), np.array([len(x)]))
    q = np.arange(len(x))
    i, j = index.near(q, np.zeros(len(q), int), 3)
    want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if bin(int(x[a] ^ x[b])).count("1") <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_gray_rank_orders_neighbours():
    codes = np.array([i ^ (i >> 1) for i in range(256)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(256))


def test_components_of_a_chain_a_star_and_noise(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1400)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (140, 100)], "u long, v long").repartition(7)
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(1000, 1400)}, 7: 7}
    assert graph.components(edges.limit(0)).count() == 0


def test_near_duplicates_with_awkward_rows(spark, docs):
    rng = random.Random(2)
    base = words(rng, 300)
    near = base.replace(base.split()[50], "changed", 1)
    rows = [(9, base), (3, near), (4, base), (4, base), (6, words(rng, 300)), (7, None), (8, ""), (None, base), (None, words(rng, 50))]
    frame = docs(rows).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(-1)).withColumn("bucket", F.lit(1))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()), key=str)
    linked = bin(plain_simhash(base) ^ plain_simhash(near)).count("1") <= 4
    c = 3 if linked else 4
    assert got == sorted([(9, c), (3, 3), (4, c), (4, c), (6, 6), (7, 7), (8, 7), (None, c), (None, None)], key=str)
    kept = simhash.distinct_documents(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*({3} if linked else {3, 4}), 6, 7, None], key=str)


def test_empty_table(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.distinct_documents(docs([])).count() == 0


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    got = simhash.op1_simhash(spark, path).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    fps = [(i, plain_simhash(t)) for i, t in texts.items()]
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{x:016x}" for i, x in fps}
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(fps)


def test_two_texts_under_one_id_both_stay(spark, docs):
    rng = random.Random(21)
    a, b, c = (words(rng, 200) for _ in range(3))
    rows = [(5, a), (5, b), (8, a), (9, b), (5, a), (2, c), (None, c), (None, "no one has this")]
    frame = docs(rows).withColumn("id", F.lit("clash")).withColumn("version", F.lit(3)).withColumn("_sh_id", F.lit(4)).withColumn("component_id", F.lit(5))
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.distinct_documents(frame).collect()), key=str)
    assert got == sorted([(5, a), (5, b), (2, c), (None, "no one has this")], key=str)
    found = simhash.near_duplicates(frame).collect()
    assert {r["component_id"] for r in found if r["doc_id"] in (5, 8, 9)} == {5}
    assert simhash.distinct_documents(frame).columns == frame.columns


@pytest.mark.parametrize("hot", [3, 50_000])
def test_hot_fingerprints_get_the_same_components(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rng = random.Random(22)
    base = words(rng, 300)
    rows = [(i, base) for i in range(40)] + [(100 + i, words(rng, 50)) for i in range(30)] + [(200 + i, "") for i in range(20)] + [(None, base)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(rows)).collect()}
    want = plain_components([(i, plain_simhash(t)) for i, t in rows if i is not None])
    assert got == {**want, None: 0} and len(got) == 91


def test_crowded_buckets_are_dealt_out_to_the_last_level(spark):
    rng = random.Random(23)
    loose = rng.sample(range(64), 14)
    fps = sorted({sum(1 << b for b in loose if rng.random() < 0.5) for _ in range(900)})
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)]
    found = {r["node"]: r["root"] for r in graph.components(simhash.links(spark.createDataFrame(rows, "ident long, fp long"), 50)).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == plain_components(list(enumerate(fps)))
