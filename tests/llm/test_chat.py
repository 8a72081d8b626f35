import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tandem.llm import chat

PIECES = ["<", "|", "\\", " ", "x", "é", "😀", chat.START, chat.SEP, chat.END, "<|endoftext|>", "</s>[INST] ok [/INST]", "\n", "hello ", "assistant"]


def random_turns(rng):
    return [(rng.choice(["user", "assistant", "a<|b", ""]), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(1, 6))]


def test_texts_come_back_from_the_format_and_from_the_mask():
    rng = random.Random(1)
    for _ in range(800):
        turns = random_turns(rng)
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        at = np.array(chat.encoder().encode(text, add_special_tokens=False).offsets).reshape(-1, 2)
        loss = chat.mask(at[:, 0], at[:, 1], spans)
        assert chat.learned_text(text, at[:, 0], at[:, 1], loss) == "".join(t for r, t in turns if r == "assistant")


def test_no_control_string_is_left_in_texts():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(PIECES) for _ in range(10))
        assert "<|" not in chat.escape(t) and chat.unescape(chat.escape(t)) == t


def test_binary_search_equals_a_scan():
    rng = np.random.default_rng(3)
    ends = np.cumsum(rng.integers(1, 5, 200))
    starts = np.r_[0, ends[:-1]]
    edges = np.sort(rng.choice(ends[-1], 20, replace=False))
    spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    want = [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends)]
    assert chat.mask(starts, ends, spans).tolist() == want


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_awkward_conversations(spark):
    rows = [(1, 1, "assistant", "second"), (1, 0, "user", "first"), (2, 0, None, None), (2, 0, None, None), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, None, "user", "z"), (None, 0, "user", "no id"), (4, 0, "assistant", "")]
    frame = conversations(spark, rows).withColumn("formatted", F.lit("clash")).withColumn("ids", F.lit(1))
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_conversations(frame).collect()}
    assert got == {1: [("user", "first"), ("assistant", "second")], 2: [("", ""), ("", "")], 3: [("user", "z"), ("assistant", "a"), ("assistant", "b")], None: [("user", "no id")], 4: [("assistant", "")]}
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_a_conversation_may_span_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t}") for c in range(40) for t in range(1 + c % 9)]
        got = chat.format_conversations(conversations(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["conv_id"]: r["n_turns"] for r in got} == {c: 1 + c % 9 for c in range(40)}


def test_query(spark):
    path = "/root/testdata/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{path}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", said), ("assistant", said)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = chat.op9_chat(spark, path).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {
        c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in turns.items()
    }
