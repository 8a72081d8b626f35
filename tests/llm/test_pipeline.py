"""The corpus pipeline, stage by stage, against plain versions of its decisions."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tandem.llm import mixing, packing, toxicity
from tandem.llm._common import staged

from .test_linededup import plain as plain_lines
from .test_simhash import plain_components, plain_simhash

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    out = [("documents", docs)]
    for name, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, PATH), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_are_named_and_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for name in ("toxicity", "line_dedup", "near_dedup", "mixing"):
        assert stages[name].schema.simpleString() == stages["documents"].schema.simpleString()


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    kept = {r["doc_id"] for r in rows(stages["toxicity"])}
    labels = rows(spark.read.parquet(f"{PATH}/labels.parquet"))
    known = [r for r in labels if r["toxic"] in (0, 1)]
    right = sum((r["doc_id"] in kept) == (r["toxic"] == 0) for r in known)
    assert right / len(known) > 0.95
    model = toxicity.train(stages["documents"], spark.read.parquet(f"{PATH}/labels.parquet"))
    assert kept == {r["doc_id"] for r in rows(stages["documents"]) if model.score(r["text"])[0] < toxicity.THRESHOLD}


def test_shared_lines_go(stages):
    want = [(i, text) for i, _, _, text in plain_lines([(r["doc_id"], r["text"]) for r in rows(stages["toxicity"])])]
    got = rows(stages["line_dedup"])
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_one_document_of_each_group_stays(stages):
    fps = [(r["doc_id"], plain_simhash(r["text"])) for r in rows(stages["line_dedup"])]
    assert {r["doc_id"] for r in rows(stages["near_dedup"])} == set(plain_components(fps).values())
    texts = {r["doc_id"]: r for r in rows(stages["line_dedup"])}
    assert all(r == texts[r["doc_id"]] for r in rows(stages["near_dedup"]))


def test_the_mix_follows_its_targets(stages):
    size, taken, before = Counter(), Counter(), {}
    for r in rows(stages["near_dedup"]):
        size[r["source"]] += len(r["text"].split())
        before[r["doc_id"]] = r["text"]
    for r in rows(stages["mixing"]):
        taken[r["source"]] += len(r["text"].split())
        assert r["text"] in before[r["doc_id"]]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, mixing.targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))])):
        assert taken[s] == pytest.approx(t, rel=0.03)


def test_packed_sequences_hold_all_tokens(stages):
    want = Counter()
    for r in rows(stages["mixing"]):
        want[r["doc_id"]] += len(packing.encode(r["text"])) + 1
    got, sequences = Counter(), defaultdict(int)
    for r in rows(stages["packing"]):
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]] += r["length"]
        assert len(r["ids"]) == r["length"]
    assert got == want and max(sequences.values()) <= 1024


def test_run_gives_the_last_stage(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    a = corpus_pipeline.run(spark, PATH).select(*columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, stages["packing"].select(*columns).collect()))


@pytest.fixture
def awkward(spark, docs):
    """Nulls in every column, repeated rows, one id with two texts, a very long text, and names that stages use themselves."""
    from pyspark.sql import functions as F

    shared = "a shared line that many of the documents hold, word for word"
    found = [(i, f"{shared}\nown words {i} {i * i} " + f"w{i} " * 30, "s%d" % (i % 3)) for i in range(12)]
    found += [(None, None, None), (50, None, "s0"), (51, "", None), (None, "no id here at all", "s1"), (3, "another text of three", "s2"), (60, "long " * 100_000, "s1"), found[4], found[4]]
    frame = docs(found).withColumn("lang", F.when(F.col("doc_id") != 5, F.col("lang")))
    for name in ("size", "target", "version", "fp", "component_id", "tox_score", "h1", "pos", "grp", "_mx_runs", "_ld_gone", "_sh_id", "blob"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_take_awkward_rows_and_empty_tables(spark, awkward, tmp_path, number):
    spark.read.parquet(f"{PATH}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[number]
    if name == "toxicity":  # its score replaces a column of that name
        awkward = awkward.drop("tox_score")
    got = rows(stage(spark, awkward, str(tmp_path)))
    assert stage(spark, awkward.limit(0), str(tmp_path)).count() == 0
    before, ids = rows(awkward), Counter(r["doc_id"] for r in got)
    if name in ("toxicity", "line_dedup"):
        assert ids == Counter(r["doc_id"] for r in before)
    if name == "near_dedup":
        assert ids[3] == 2 and ids[4] == 1 and ids[60] == 1 and ids[50] + ids[51] == 1
    if name == "mixing":
        assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in before if r["text"]}
    if name == "packing":
        assert sum(r["length"] for r in got) == sum(len(packing.encode(r["text"] or "")) + 1 for r in before)
    else:
        assert all(set(r) == set(awkward.columns) and r["_mx_runs"] == "clash" for r in got)
