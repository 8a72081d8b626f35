import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tandem.llm import _common, linededup

SPACE = " \t\n\x0b\x0c\r"


def plain(rows, key_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= key_chars and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= key_chars and len(holders[key(x)]) >= min_docs and i is not None and max(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(frame, **kw):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in linededup.dedup_lines(frame, **kw).collect()), key=str)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_against_a_plain_version(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(linededup, "BROADCAST_POSITIONS", limit)
    monkeypatch.setattr(_common, "BROADCAST_ROWS", limit)
    rng = random.Random(8)
    lines = ["L%d %s" % (i, "abcÉé" * rng.randint(1, 12)) for i in range(30)] + ["", " ", "x", "  PADDED " + "Q" * 45 + "\t\r", "padded " + "q" * 45, "\x0b" + "e" * 40, "é" * 40, "😀" * 39]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n".join(lines)), (None, "\n".join(lines)), (103, "\n".join(lines)), (104, "\n".join(lines[:5]))]
    assert got(docs(rows)) == plain(rows)


def test_counts_are_of_documents_not_rows(spark, docs):
    line = "z" * 50
    rows = [(1, line + "\n" + line + "\n" + line)] * 4 + [(2, line), (3, line), (4, line)]
    assert got(docs(rows)) == plain(rows)  # four documents, though thirteen lines
    rows += [(5, "y\n" + line)]
    assert got(docs(rows)) == plain(rows)


def test_columns_pass_through_and_clashes_are_replaced(spark, docs):
    frame = docs([(1, "a\nb")]).withColumn("n_lines", F.lit("x")).withColumn("h1", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("keeper", F.lit(0))
    out = linededup.dedup_lines(frame)
    assert out.columns == [c for c in frame.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert out.first()["n_lines"] == 2 and out.first()["keeper"] == 0


def test_a_very_long_text(spark, docs):
    long = "\n".join("line number %06d %s" % (i, "w" * 40) for i in range(20_000))
    rows = [(i, long) for i in range(5)]
    assert got(docs(rows)) == plain(rows)


def test_empty_table(spark, docs):
    assert linededup.dedup_lines(docs([])).count() == 0


def test_plan_has_no_python(spark):
    plan = linededup.op10_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_reserved_names_do_not_clash(spark, docs):
    rows = [(i, "z" * 50 + f"\nown {i}") for i in range(6)]
    frame = docs(rows)
    for name in ("_ld_gone", "ld_gone", "_ld_id", "ld_id", "ld_v", "LD_version"):
        frame = frame.withColumn(name, F.lit("clash"))
    out = linededup.dedup_lines(frame)
    assert out.columns == [*frame.columns, "n_lines", "n_dropped"] and out.where("ld_gone = 'clash'").count() == 6
    assert got(frame) == plain(rows)
