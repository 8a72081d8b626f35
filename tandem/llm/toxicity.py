"""Toxicity by multiple-instance learning: documents are bags of sentences, joined by noisy-or.

Only document labels are known. A sentence's score is a logistic function of its words and their beginnings; a document
is toxic unless none of its sentences is: P = 1 - prod(1 - p). Sentences count by what they have above the background,
which each document has once, so sentences without evidence add nothing, however many there are; and in documents of more
than SHARED sentences each one's odds are divided, so that chance evidence doesn't add up with length. Fit and scores
follow the same rule. The likelihood of the labels less an absolute penalty is maximised over the word weights, so blame
settles on the sentences that tell toxic documents from others, which then can be located.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table, text_of

#: The training sample holds at most this many labelled documents of each class (the fit's documented bound), ...
SAMPLE = {1: 3000, 0: 5000}
#: ... and the vocabulary at most this many features, those that tell the classes apart best.
VOCABULARY, LEAST_DOCS, LEAST_Z = 20_000, 3, 2.0
#: Log-odds of a document without evidence; a sentence's evidence is added to it.
BACKGROUND = -10.0
#: Sentences up to which each counts in full; beyond, a document's sentences share what so many would have.
SHARED = 30
EPOCHS, RATE, SHRINK = 400, 0.15, 2e-4
THRESHOLD = 0.5
_SENTENCE = re.compile(r"[^.!?\n]+")
_TOKEN = re.compile(r"\w+")


def features(word: str) -> tuple[str, ...]:
    """A word, and its first four and five letters if it goes on."""
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n))


def _dilution(sentences: int) -> float:
    """What a sentence's log-odds lose in a long document, so that chance evidence of many sentences doesn't add up."""
    return math.log(max(1.0, sentences / SHARED))


@dataclass
class Model:
    """weights by feature; words caches the sum over a word's features, full and heads what a word with weight looks like."""

    weights: dict[str, float]
    bias: float = BACKGROUND
    words: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.full = {f for f in self.weights if not f.endswith("*")}
        self.heads = {f[:4] for f in self.weights if f.endswith("*")}

    def word(self, w: str) -> float:
        got = self.words.get(w)
        if got is None:
            if len(self.words) > 50_000:
                self.words.clear()
            got = self.words[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return got

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, log-odds) of the sentences that hold evidence."""
        out, word, n = [], self.word, 0
        for m in _SENTENCE.finditer(text or ""):
            tokens = set(_TOKEN.findall(m.group().lower()))
            n += bool(tokens)
            if s := sum(map(word, tokens)):
                out.append((*m.span(), s + self.bias))
        less = _dilution(n)
        return [(a, z, s - less) for a, z, s in out] if less else out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over the background, once a text, and what its sentences with evidence have above it."""
        text = text or ""
        words = set(_TOKEN.findall(text.lower()))
        # Most texts hold no word with weight and are not cut up.
        none = self.full.isdisjoint(words) and self.heads.isdisjoint({w[:4] for w in words})
        found = [] if none else self.sentences(text)
        base = float(np.logaddexp(0, self.bias))
        clean = -base - sum(max(0.0, float(np.logaddexp(0, s)) - base) for *_, s in found)
        return float(-np.expm1(clean)), found


def _document_features(text: str | None) -> set[str]:
    return {f for w in set(_TOKEN.findall((text or "").lower())) for f in features(w)}


def _chosen(found: dict[str, tuple[int, int]], n0: int, n1: int) -> dict[str, float]:
    """Log-odds of the features that tell toxic documents best: found has each feature's documents by class."""
    if not n0 or not n1:
        return {}
    names = [f for f, c in found.items() if sum(c) >= LEAST_DOCS]
    c = np.array([found[f] for f in names], float).reshape(-1, 2)
    odds = np.log((c[:, 1] + 0.5) / (n1 + 1)) - np.log((c[:, 0] + 0.5) / (n0 + 1))
    z = odds / np.sqrt(1 / (c[:, 1] + 0.5) + 1 / (c[:, 0] + 0.5))
    best = sorted((i for i in range(len(names)) if z[i] > LEAST_Z), key=lambda i: (-z[i], names[i]))[:VOCABULARY]
    return {names[i]: float(odds[i]) for i in sorted(best, key=lambda i: names[i])}


def _bag(text: str | None, number: dict[str, int]) -> tuple[Counter[tuple[int, ...]], float]:
    """How often each set of known features occurs among a text's sentences, without the empty set; and the dilution."""
    out: Counter[tuple[int, ...]] = Counter()
    n = 0
    for m in _SENTENCE.finditer(text or ""):
        tokens = set(_TOKEN.findall(m.group().lower()))
        n += bool(tokens)
        if known := {number[f] for w in tokens for f in features(w) if f in number}:
            out[tuple(sorted(known))] += 1
    return out, _dilution(n)


def _learn(bags: list[tuple[int, Counter[tuple[int, ...]], float]], odds: dict[str, float], n: int) -> Model:
    """The weights of greatest likelihood less SHRINK times their absolute sum, by proximal steps scaled as Adam's.

    bags: label, sentences and dilution of each document with known features; n: all documents. The penalty is part of the
    objective, so weights that it holds at zero are exactly zero and drop out without a cut.
    """
    y = np.array([label for label, *_ in bags], int)
    doc = np.repeat(np.arange(len(bags)), [len(b) for _, b, _ in bags])
    bias = BACKGROUND - np.array([less for *_, less in bags])[doc]
    times = np.array([t for _, b, _ in bags for t in b.values()], float)
    sizes = [len(k) for _, b, _ in bags for k in b]
    inst = np.repeat(np.arange(len(sizes)), sizes)
    feat = np.array([f for _, b, _ in bags for k in b for f in k], int)
    w = np.maximum(0, np.array(list(odds.values()), float))
    m, v, base = np.zeros_like(w), np.zeros_like(w), np.logaddexp(0, BACKGROUND)
    for t in range(1, EPOCHS + 1):
        s = bias + np.bincount(inst, w[feat], len(doc))
        p = np.where(s >= BACKGROUND, 1 / (1 + np.exp(-s)), 0.0)
        log_q = -base - np.bincount(doc, times * np.maximum(0, np.logaddexp(0, s) - base), len(bags))
        big = -np.expm1(log_q)
        blame = np.where(y[doc] == 1, np.exp(log_q[doc]) / np.maximum(big[doc], 1e-12), -1.0) * p * times
        g = -np.bincount(feat, blame[inst], len(w)) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w = w - step * (m / (1 - 0.9**t))
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * SHRINK)
    return Model({f: float(x) for f, x in zip(odds, w) if x})


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of these documents, on the driver. Needs both classes; else only the background."""
    found: dict[str, list[int]] = {}
    for text, label in zip(texts, labels):
        for f in _document_features(text):
            found.setdefault(f, [0, 0])[label] += 1
    odds = _chosen({f: (c[0], c[1]) for f, c in found.items()}, labels.count(0), labels.count(1))
    number = {f: k for k, f in enumerate(odds)}
    bags = [(label, *bag) for text, label in zip(texts, labels) if (bag := _bag(text, number))[0]]
    return _learn(bags, odds, len(texts)) if bags else Model({})


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, toxic, text): at most per_class documents of each label, chosen by a seeded hash of their ids.

    Held-out ids, null labels and null ids are left out. An id with several labels is toxic if one of them says so; of
    several texts of an id the one with the smallest hash is taken.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    known = staged(known, "toxic-labels")
    rows = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    order, chosen = F.xxhash64(F.lit(7), "doc_id"), None
    for label, most in (per_class or SAMPLE).items():
        part = known.where(F.col("toxic") == label)
        if rows.get(label, 0) > 2 * most:  # a threshold leaves a little more than is taken, so that no task sorts them all
            part = part.where(F.pmod(order, F.lit(1 << 30)) < math.ceil((1.2 * most + 100) / rows[label] * (1 << 30)))
        part = part.orderBy(order, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = staged(chosen.select(F.col("doc_id").alias("_tx_id"), "toxic"), "toxic-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_tx_id"))  # at most per_class rows
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by(text_of(), F.struct(F.xxhash64(text_of()), F.octet_length(text_of()))).alias("text"))
    return staged(texts, "toxic-texts")


def train(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None) -> Model:
    """A model from a bounded, seeded sample of labelled documents.

    Texts stay with the workers. The driver gets at most VOCABULARY features with their counts, and for each sampled
    document the distinct sets of these features that its sentences hold.
    """
    spark = docs.sparkSession
    texts = sample(docs, labels, per_class)
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}  # two rows
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model({})

    def counted(it):
        for b in it:
            per: dict[str, list[int]] = {}
            for label, text in zip(b.column("toxic").to_pylist(), b.column("text")):
                for f in _document_features(text.as_py()):
                    per.setdefault(f, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(per), pa.string()), *(pa.array([c[k] for c in per.values()], pa.int64()) for k in (0, 1))], names=["feature", "c0", "c1"])

    counts = texts.mapInArrow(counted, "feature string, c0 long, c1 long").groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where(F.col("c0") + F.col("c1") >= LEAST_DOCS)
    c0, c1 = F.col("c0") + 0.5, F.col("c1") + 0.5
    z = (F.log(c1 / (n1 + 1)) - F.log(c0 / (n0 + 1))) / F.sqrt(1 / c1 + 1 / c0)
    best = counts.withColumn("z", z).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "feature").limit(VOCABULARY)
    odds = _chosen({r["feature"]: (r["c0"], r["c1"]) for r in best.collect()}, n0, n1)
    sent = spark.sparkContext.broadcast({f: k for k, f in enumerate(odds)})  # at most VOCABULARY features

    def bagged(it):
        number = sent.value
        for b in it:
            for doc, label, text in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), b.column("text")):
                bag, less = _bag(text.as_py(), number)
                if bag:
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([label], pa.int32()), pa.array([list(map(list, bag))], pa.list_(pa.list_(pa.int32()))), pa.array([list(bag.values())], pa.list_(pa.int64())), pa.array([less])], names=["doc_id", "toxic", "sets", "times", "less"])

    rows = texts.mapInArrow(bagged, "doc_id long, toxic int, sets array<array<int>>, times array<long>, less double").collect() if odds else []
    rows.sort(key=lambda r: r["doc_id"])
    bags = [(r["toxic"], Counter({tuple(k): t for k, t in zip(r["sets"], r["times"])}), r["less"]) for r in rows]
    return _learn(bags, odds, n0 + n1) if bags else Model({})


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with tox_score (double) and tox_spans: the offending sentences (start, end in code points, p >= 0.5).

    Works on whole texts of any length; null, empty and wordless texts get the background score. Labels, language, source
    and ids take no part, so rows that repeat a text get its score each. A score of just THRESHOLD counts as toxic.
    Columns pass through, but tox_score and tox_spans are replaced. Empty in, empty out.
    """
    docs = docs.drop("tox_score", "tox_spans")
    names = docs.columns
    out = docs.select(*names, F.lit(0.0).alias("tox_score"), F.expr("cast(null as array<struct<start:int,end:int,p:double>>)").alias("tox_spans")).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY weights

    def batches(it):
        own = sent.value
        for b in it:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                scores, spans = [], []
                for text in part.column("text"):
                    p, found = own.score(text.as_py())
                    scores.append(p)
                    spans.append([{"start": a, "end": z, "p": float(1 / (1 + np.exp(-s)))} for a, z, s in found if s >= 0])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(spans, _SPANS)], names=[*names, "tox_score", "tox_spans"])

    return docs.mapInArrow(batches, out)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"), F.size("tox_spans").alias("offending"))
