import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


def nearest(rows, query_id, k=20):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and i is not None]
    q = next(v for i, v in usable if i == query_id)
    return sorted(((-float(v @ q), i) for i, v in usable if i != query_id))[:k]


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("normal", [True, False])
def test_recall_and_scores(spark, normal):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)) * (1 if normal else rng.uniform(0.2, 3, (1500, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = frame(spark, rows).withColumn("vec", F.lit(1)).withColumn("list", F.lit(2)).withColumn("rank", F.lit(3))
    got = result(ann.search(vectors, vectors.where("vec_id % 20 = 0")))
    assert len(got) == 75
    hits = 0
    for q, found in got.items():
        want = nearest(rows, q)
        assert [r for r, *_ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(float(np.float32(x[i]).astype(float) @ np.float32(x[q]).astype(float)), abs=1e-9)
        hits += len({i for _, i in want} & {i for _, i, _ in found})
    assert hits / (75 * 20) >= 0.9


def test_ties_and_repeated_vectors(spark):
    rng = np.random.default_rng(6)
    same = rng.normal(size=8).tolist()
    rows = [(i, same) for i in range(0, 200)] + [(i, rng.normal(size=8).tolist()) for i in range(200, 260)]
    rows += [(5, same)]  # repeated in full
    got = result(ann.search(frame(spark, rows), frame(spark, rows).where("vec_id % 20 = 0")))
    assert sorted(got) == list(range(0, 260, 20))
    first = sum(s * s for s in np.float32(same).astype(float))
    for q in range(0, 200, 20):
        assert [i for _, i, _ in got[q]] == [i for i in range(22) if i != q][:20]
        assert got[q][0][2] == pytest.approx(first)


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (20, [0, 0]), (40, None), (60, [1, None]), (80, [nan, 1]), (100, [inf, 1]), (3, [0.5, 0.5]), (4, [-1, 0]), (None, [1, 1]), (120, [])]
    got = result(ann.search(frame(spark, rows), frame(spark, rows).where("vec_id % 20 = 0")))
    assert got == {0: [(1, 3, 0.5), (2, 4, -1.0)]}


def test_few_or_no_vectors(spark):
    assert ann.search(frame(spark, []), frame(spark, [])).count() == 0
    one = frame(spark, [(0, [1, 2])])
    assert ann.search(one, one).count() == 0


def test_long_lists_are_searched_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 16)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * 0.01 + [1, 0, 0, 0]).tolist()) for i in range(400)]
    got = result(ann.search(frame(spark, rows), frame(spark, rows).where("vec_id = 0")))
    want = [i for _, i in nearest(rows, 0)]
    assert len(set(want) & {i for _, i, _ in got[0]}) >= 18


def test_the_test_abandons_few_true_neighbours():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(50, 64))
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    bound = np.sort(d, axis=1)[:, 19]
    i, j = ann.scan_list(x, q, bound)
    kept = set(zip(i.tolist(), j.tolist()))
    true = {(a, b) for a in range(50) for b in np.flatnonzero(d[a] <= bound[a])}
    assert kept <= true and len(kept) / len(true) > 0.97


def test_queries_of_a_list_are_dealt_out_too(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_CHUNK", 7)
    monkeypatch.setattr(ann, "CHUNK", 50)
    rng = np.random.default_rng(18)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    got = result(ann.search(frame(spark, rows), frame(spark, rows).where("vec_id % 5 = 0")))
    assert len(got) == 60 and all(len(found) == 20 for found in got.values())
    hits = sum(len({i for _, i in nearest(rows, q)} & {i for _, i, _ in found}) for q, found in got.items())
    assert hits / 1200 >= 0.9


def test_double_precision_vectors(spark):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(200, 5))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = result(ann.search(vectors, vectors.where("vec_id % 20 = 0")))
    for q, found in got.items():
        for _, i, s in found:
            assert s == pytest.approx(float(x[i] @ x[q]), abs=1e-12)


def test_the_driver_gets_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 300)
    rng = np.random.default_rng(20)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1500)]
    got = result(ann.search(frame(spark, rows), frame(spark, rows).where("vec_id % 20 = 0")))
    hits = sum(len({i for _, i in nearest(rows, q)} & {i for _, i, _ in found}) for q, found in got.items())
    assert hits / (75 * 20) >= 0.85  # a fifth of the rows is a small sample to calibrate on


def test_query_recall_against_brute_force(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = result(ann.op5_ann(spark, path))
    hits = total = 0
    for q, found in got.items():
        want = nearest(rows, q)
        total += len(want)
        hits += len({i for _, i in want} & {i for _, i, _ in found})
    assert len(got) == sum(i % 20 == 0 for i, _ in rows) and hits / total >= 0.9
