import random
import re

import pytest
from pyspark.sql import functions as F

from tandem.llm import _common, secrets

PATTERNS = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def base(text):
    out = [(m.start(), n, kind, m.end()) for n, (kind, (p, g, least)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if len(m.group(g)) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


PIECES = ["token", "TOKEN", "secret", "api_key", "apikey", "passwd", "PassWord", ":", "=", " ", "'", '"', "abcdefgh", "x", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "😀", "K", "\n", "deadbeef" * 4, "-----BEGIN RSA PRIVATE KEY-----"]


def test_spans_match_plain_regular_expressions(spark, docs):
    rng = random.Random(5)
    texts = [None, "", "a" * 100_000, "token: token: abcdefgh", ("f" * 31 + " ") * 2000] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    got = {r["doc_id"]: r for r in secrets.by_version(secrets.update(docs(list(enumerate(texts))))).collect()}
    assert {i: r["base_spans"] for i, r in got.items()} == {i: base(t) for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        for span in filter(None, got[i]["spans"].split(",")):
            kind, a, b = span.split(":")
            assert kind != "pem" or t[int(a) : int(b)] == "-----BEGIN RSA PRIVATE KEY-----"
        assert set(got[i]["base_spans"].split(",")) <= set(got[i]["spans"].split(",")) | {""}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_each_blob_is_scanned_once_and_found_on_all_paths(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(_common.lookup, "__defaults__", (limit,))
    secret = "token=" + "z" * 12
    frame = docs([(1, secret), (2, secret), (3, secret), (3, secret), (None, secret), (None, "AKIA" + "A" * 20), (None, "AKIA" + "A" * 20), (4, "plain")])
    ledger = secrets.update(frame.withColumn("blob", F.lit("clash")).withColumn("rule", F.lit(0)))
    assert ledger.findings.count() == 2
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"]) for r in secrets.by_version(ledger).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 1, 0), (3, 1, 0), (3, 1, 0), (None, 1, 0), (None, 0, 1), (None, 0, 1), (4, 0, 0)], key=str)


def test_the_ledger_is_incremental(spark, docs):
    first = secrets.update(docs([(1, "token=abcdefgh1"), (2, "nothing")]), rules=secrets.RULES[:2])
    assert first.seen.count() == 4
    again = secrets.update(docs([(3, "token=abcdefgh1"), (4, "AKIA" + "B" * 16)]), first, secrets.RULES[:2])
    assert again.seen.count() == 6 and again.findings.count() == 2 and again.versions.count() == 4
    newer = secrets.Rule("assign", secrets.RULES[0].pattern, 8, 1, version=2)
    later = secrets.update(docs([(5, "token=abcdefgh1")]), again, (newer, secrets.RULES[1]))
    assert {r["rule_name"] for r in later.seen.exceptAll(again.seen).collect()} == {"assign/2"}
    assert {r["doc_id"]: r["n_assign"] + r["n_access"] for r in secrets.by_version(first, secrets.RULES[:2]).collect()} == {1: 1, 2: 0}


def test_empty_table(spark, docs):
    assert secrets.by_version(secrets.update(docs([]))).count() == 0


@pytest.mark.parametrize("name", ["op3_secrets"])
def test_plan_has_no_python(spark, name):
    plan = secrets.op3_secrets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def answers(ledger, rules=secrets.RULES):
    return sorted(map(tuple, secrets.by_version(ledger, rules).collect()), key=str)


def bumped(rules, n):
    return tuple(secrets.Rule(r.kind, r.pattern, r.least, r.group, r.holds, r.version + (i == n)) for i, r in enumerate(rules))


TEXTS = ["token=abcdefgh1 and AKIA" + "C" * 16, "nothing", "secret: zzzzzzzz", "é " + "0a" * 20, None]


@pytest.mark.parametrize("texts", [True, False])
def test_after_a_rule_bump_and_a_reordering_the_answer_is_plain(spark, docs, tmp_path, texts):
    rows = list(enumerate(TEXTS))
    newer = bumped(secrets.RULES, 0)
    turned = tuple(reversed(newer))
    ledger = secrets.update(docs(rows), secrets.open_ledger(spark, f"{tmp_path}/a", texts))
    plain = answers(secrets.update(docs([*rows, (9, TEXTS[0])]), rules=newer), newer)
    ledger = secrets.update(docs([(9, TEXTS[0])]), ledger, newer)
    got = {r["doc_id"]: r for r in secrets.by_version(ledger, newer).collect()}
    assert got[0]["n_assign"] == got[9]["n_assign"] == 1 and got[0]["spans"].count("assign") == 1
    if texts:  # the blobs of the first update were scanned with the new version too
        assert answers(ledger, newer) == plain
    else:  # and otherwise are known not to have been
        assert got[2]["n_assign"] is None and got[2]["n_hex"] == 0
        ledger = secrets.update(docs(rows), ledger, newer)
        assert answers(ledger, newer) == plain
    again = secrets.update(docs([(10, "plain")]), ledger, turned)
    fields = ["doc_id", "n_assign", "n_access", "n_hex", "n_pem", "n_github"]
    pick = lambda l, rules: sorted(map(tuple, secrets.by_version(l, rules).where("doc_id < 10").select(*fields).collect()), key=str)
    assert pick(again, turned) == pick(ledger, newer)
    assert again.seen.exceptAll(ledger.seen).select("blob").distinct().count() == 1


def test_a_document_sent_again_is_no_new_version(spark, docs, tmp_path):
    rows = list(enumerate(TEXTS))
    one = secrets.update(docs(rows), path=f"{tmp_path}/l")
    two = secrets.update(docs(rows[:2] + [(0, "changed: token=qqqqqqqq")]), one)
    assert two.versions.count() == len(rows) + 1
    assert two.seen.count() == one.seen.count() + len(secrets.RULES) and two.seen.distinct().count() == two.seen.count()
    assert answers(two) == answers(secrets.update(docs([*rows, (0, "changed: token=qqqqqqqq")])))
    assert answers(one) == answers(secrets.update(docs(rows)))


def test_a_second_session_goes_on_from_the_folder(spark, docs, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/l", [(i, f"token=abcdefg{i} {t or ''}") for i, t in enumerate(TEXTS)]
    monkeypatch.setattr(secrets, "MOST_PARTS", 3)
    for row in rows:
        secrets.update(docs([row]), secrets.open_ledger(spark.newSession(), path))
    last = secrets.open_ledger(spark.newSession(), path)
    assert len(last.parts) <= 3 and last.number > len(rows)
    assert answers(last) == answers(secrets.update(docs(rows)))


def test_of_two_updates_of_one_state_the_second_fails_and_leaves_nothing(spark, docs, tmp_path):
    start = secrets.update(docs([(1, "token=abcdefgh1")]), path=f"{tmp_path}/l")
    first = secrets.update(docs([(2, "a")]), start)
    with pytest.raises(secrets.LedgerConflict):
        secrets.update(docs([(3, "b")]), start)
    now = secrets.open_ledger(spark, f"{tmp_path}/l")
    assert now.number == first.number and answers(now) == answers(first)


def test_a_rule_must_not_change_under_its_name(spark, docs):
    ledger = secrets.update(docs([(1, "x")]))
    with pytest.raises(ValueError):
        secrets.update(docs([(2, "y")]), ledger, (secrets.Rule("assign", "other", 1),))


def test_a_hot_blob_with_findings(spark, docs, monkeypatch):
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
    frame = docs([(i, "token=" + "h" * 10) for i in range(300)] + [(i, f"t{i}") for i in range(300, 600)])
    assert secrets.by_version(secrets.update(frame)).where("n_assign = 1").count() == 300
