import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tandem.llm import toxicity

from .conftest import words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    bad = ["grumblefoo", "snarkbart", "blortish"]
    rows = []
    for i in range(600):
        sentences = [words(rng, rng.randint(4, 12)) for _ in range(rng.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            sentences.insert(rng.randint(0, len(sentences)), f"you {rng.choice(bad)} {words(rng, 3)}")
        rows.append((i, ". ".join(sentences) + ".", int(toxic)))
    return rows


def test_noisy_or_learns_from_document_labels_and_locates_sentences(corpus):
    model = toxicity.fit([t for _, t, _ in corpus[:400]], [y for *_, y in corpus[:400]])
    for _, text, y in corpus[400:]:
        p, found = model.score(text)
        assert (p >= 0.5) == (y == 1)
        if y:
            worst = max(found, key=lambda s: s[2])
            assert any(w in text[worst[0] : worst[1]] for w in ("grumblefoo", "snarkbart", "blortish"))


def test_long_clean_documents_stay_clean(corpus):
    model = toxicity.fit([t for _, t, _ in corpus], [y for *_, y in corpus])
    assert model.score(". ".join(words(random.Random(9), 10) for _ in range(2000)))[0] < 0.5
    assert model.score("x" * 300_000)[0] < 0.5


def test_sentences_without_evidence_add_nothing(corpus):
    model = toxicity.fit([t for _, t, _ in corpus], [y for *_, y in corpus])
    line = "a wordless zq. \n"
    assert not model.sentences(line)
    assert model.score(line * 100_000)[0] == model.score(line)[0] < 0.5
    mild = toxicity.Model({"fine": -1.0, "bad": 20.0})
    assert mild.score("fine. " * 100_000)[0] == mild.score("")[0] < 0.5
    assert mild.score("fine. " * 100_000 + "so bad.")[0] > 0.5


def test_one_class_gives_the_background():
    model = toxicity.fit(["a b", "c d"], [0, 0])
    assert 0 <= model.score("a")[0] < 0.01 and model.score(None)[0] == model.score("")[0]


def test_training_leaves_out_held_out_ids_and_odd_labels(spark, docs, corpus):
    held = {i for i, *_ in corpus if zlib.crc32(str(i).encode()) % 5 == 0}
    poisoned = [(i, f"heldoutword {t}" if i in held else t, y) for i, t, y in corpus]
    labels = [(i, 1, 1 if i in held else y) for i, _, y in poisoned] + [(None, 1, 1), (3, 1, None), (5, 1, 7)]
    model = toxicity.train(docs([(i, t) for i, t, _ in poisoned]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert not any("heldout" in f for f in model.weights)
    assert model.score("you grumblefoo there")[0] > 0.5


def test_scores_of_awkward_rows(spark, docs):
    model = toxicity.Model({"bad": 20.0})
    frame = docs([(1, "so bad. fine"), (1, "so bad. fine"), (2, None), (3, ""), (None, "bad"), (4, "\n.?!")]).withColumn("tox_score", F.lit("clash"))
    got = [(r["doc_id"], round(r["tox_score"], 2), [(s["start"], s["end"]) for s in r["tox_spans"]]) for r in toxicity.score(frame, model).collect()]
    assert sorted(got, key=str) == sorted([(1, 1.0, [(0, 6)]), (1, 1.0, [(0, 6)]), (2, 0.0, []), (3, 0.0, []), (None, 1.0, [(0, 3)]), (4, 0.0, [])], key=str)
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_other_column_types_pass_through(spark, docs):
    frame = docs([(1, "so bad"), (2, None)]).withColumn("tags", F.array(F.lit("t"))).withColumn("at", F.lit("2020-01-01").cast("timestamp_ntz")).withColumn("d", F.lit(1).cast("decimal(9,2)"))
    got = toxicity.score(frame, toxicity.Model({"bad": 20.0}))
    assert got.drop("tox_score", "tox_spans").schema.simpleString() == frame.schema.simpleString()
    assert sorted((r["doc_id"], r["tags"], str(r["d"])) for r in got.collect()) == [(1, ["t"], "1.00"), (2, ["t"], "1.00")]


def test_empty_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs([(1, "a")]), none).weights == {}


def test_query_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    got = toxicity.op2_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    held = got.where("held_out").collect()
    assert len(held) > 30
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in held) / len(held) > 0.95
    assert got.where("predicted <> cast(score >= 0.5 as int)").count() == 0
    ids = [r["doc_id"] for r in held]
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)


def plain_score(model, text):
    """The noisy-or of the module's docstring, sentence by sentence, without screens or caches."""
    text = text or ""
    sentences = [set(re.findall(r"\w+", s.lower())) for s in re.split(r"[.!?\n]", text)]
    n = sum(bool(s) for s in sentences)
    quiet = 1 / (1 + math.exp(-model.bias))
    clean = 1 - quiet
    for words_ in sentences:
        evidence = sum(model.weights.get(f, 0.0) for w in words_ for f in {w, *([w[:4] + "*"] if len(w) > 4 else []), *([w[:5] + "*"] if len(w) > 5 else [])})
        if evidence:
            p = 1 / (1 + math.exp(-(model.bias + evidence - math.log(max(1, n / toxicity.SHARED)))))
            clean *= min(1.0, (1 - p) / (1 - quiet))
    return 1 - clean


def test_scores_match_a_plain_noisy_or(spark, corpus):
    model = toxicity.fit([t for _, t, _ in corpus[:400]], [y for *_, y in corpus[:400]])
    rng = random.Random(6)
    texts = [None, "", " .\n!", *(t for _, t, _ in corpus[400:]), ". ".join(rng.choice(corpus)[1] for _ in range(60))]
    for t in texts:
        assert model.score(t)[0] == pytest.approx(plain_score(model, t), abs=1e-9)


def test_query_against_plain_version(spark):
    path = "/root/testdata/sf0.001"
    docs_, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs_, labels)
    texts = {r["doc_id"]: r["text"] for r in docs_.collect()}
    got = toxicity.op2_toxicity(spark, path).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)


def test_workers_and_driver_fit_alike(spark, docs, corpus):
    known = [(i, t, y) for i, t, y in corpus if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus], "doc_id long, quality int, toxic int")
    frame = docs([(i, t) for i, t, _ in corpus] + [(corpus[1][0], corpus[1][1])])
    near = toxicity.train(frame, labels).weights
    far = toxicity.fit([t for _, t, _ in known], [y for *_, y in known]).weights
    assert near.keys() == far.keys() and all(near[f] == pytest.approx(far[f]) for f in far)


def test_the_penalty_and_not_a_cut_leaves_weights_out(corpus):
    texts, labels = [t for _, t, _ in corpus[:300]], [y for *_, y in corpus[:300]]
    model = toxicity.fit(texts, labels)

    def objective(weights):
        m = toxicity.Model(weights)
        total = 0.0
        for t, y in zip(texts, labels):
            p = min(max(plain_score(m, t), 1e-12), 1 - 1e-12)
            total += math.log(p if y else 1 - p)
        return total / len(texts) - toxicity.SHRINK * sum(map(abs, weights.values()))

    best = objective(model.weights)
    for f, w in list(model.weights.items())[:8]:
        for step in (-0.5, 0.5):
            assert objective({**model.weights, f: w + step}) <= best + 1e-4
    assert objective({**model.weights, "absentword": 0.5}) < best


def test_length_alone_makes_no_document_toxic(spark):
    path = "/root/testdata/sf0.01"
    docs_, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs_, labels)
    clean = [r["text"] for r in docs_.join(labels.where("toxic = 0"), "doc_id").collect() if model.score(r["text"])[0] < 0.1]
    pool = [s for t in clean for s in re.split(r"[.!?\n]", t) if s.strip()]
    rng = random.Random(8)
    began = time.perf_counter()
    for n in (1000, 15_000, 100_000):
        assert model.score(". ".join(rng.choice(pool) for _ in range(n)))[0] < 0.5
    assert model.score("\n".join(",".join(f"{rng.random():.4f}" for _ in range(8)) for _ in range(18_000)))[0] < 0.5
    for text in (" " * 1_000_000, "\n" * 1_000_000):
        assert model.score(text)[0] == model.score("")[0]
    assert time.perf_counter() - began < 60


def test_the_sample_is_bounded_and_rests_on_ids(spark, docs, corpus):
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus], "doc_id long, quality int, toxic int")
    frame = docs([(i, t) for i, t, _ in corpus])
    some = toxicity.sample(frame, labels, {1: 20, 0: 30})
    assert {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()} == {0: 30, 1: 20}
    again = toxicity.sample(frame.unionByName(frame).repartition(5), labels, {1: 20, 0: 30})
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, again.collect()))
    assert toxicity.train(docs([]), labels).weights == {}
