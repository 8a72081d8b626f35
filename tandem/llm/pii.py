"""Personal data: fixed patterns, and identifiers that bootstrapped contexts discover.

The base finds e-mail addresses, IPv4 addresses, card and phone numbers. They seed a bootstrap. The words around a known
entity make lexical patterns: two words to its left, two to its right, or one on either side. Each round takes the
patterns that enough known instances induce, collects all instances that stand in them anywhere, and Spark scores the
graph of patterns and instances: a pattern's confidence is the share of its known instances, against ordinary words,
entities of other kinds and strangers as far as they are doubtful; a stranger's is the noisy-or of its patterns'. Strangers
of high confidence are known in the next round and induce patterns themselves, wherever they stand. In the end, patterns
of high confidence name the identifiers in their slots.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lookup, staged, table, text_of

KINDS = ("email", "ip", "card", "phone")
#: Rounds of bootstrapping, and of scoring in each; the least known instances and confidence of a pattern; pseudo-counts.
BOOTSTRAPS, ROUNDS, LEAST_SEEDS, CONFIDENT, SHRINK = 3, 3, 5, 0.8, 1.0
#: A pattern must hold this share of its kind's known instances too, so that chance contexts don't pass in a large corpus.
LEAST_SHARE = 1e-3
#: What a stranger, an instance that no pattern vouches for, counts against its pattern.
DOUBT = 0.5
#: What may be an unseen identifier: a token of this length at least that isn't an ordinary word.
LEAST_CHARS = 3
#: Longer words make no pattern, and words further apart don't belong to one.
MOST_WORD, MOST_GAP = 30, 8
_REACH = 2 * (MOST_WORD + MOST_GAP) + 1
#: Patterns or instances that one pass over the documents looks for (about 100 bytes each); more take more passes.
BLOCK = 200_000
STRANGER, ORDINARY = -1, -2

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails as a whole fails from any later digit too, so runs are entered at their first digit only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\w(?:[\w@._+/%-]*\w)?")
_STOP = re.compile(r"[.!?\n]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @ back over the local part, but not into the match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        else:
            done = at + 1  # the next local part can't reach over an @
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p) <= 255 for p in (part.lstrip("0")[:4] or "0" for part in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str, a: int = 0, b: int | None = None) -> tuple[list[int], list[int], list[str]]:
    """Starts, ends and lower-cased words of the tokens that lie in text[a:b], without punctuation at their ends."""
    b = len(text) if b is None else b
    starts, ends, words = [], [], []
    for m in _TOKEN.finditer(text, a, b):
        if m.start() == a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_@.+/%-"):
            continue  # begins before a
        if m.end() == b < len(text) and (text[b].isalnum() or text[b] in "_@.+/%-"):
            continue  # goes on after b
        starts.append(m.start())
        ends.append(m.end())
        words.append(m.group().lower())
    return starts, ends, words


def _joined(text: str, a: int, b: int, word: str) -> bool:
    """Whether a word belongs to the pattern of what stands beyond the gap text[a:b]."""
    return 0 <= b - a <= MOST_GAP and len(word) <= MOST_WORD and not _STOP.search(text, a, b)


def patterns_at(text: str, a: int, b: int, at: tuple[list[int], list[int], list[str]]) -> list[str]:
    """The lexical patterns around text[a:b]: "l: two words before", "r: two words after" and "b: one before _ one after"."""
    starts, ends, words = at
    i = bisect_left(ends, a + 1) - 1  # the last token that ends by a
    j = bisect_left(starts, b)  # the first that starts from b on
    out = []
    before = i >= 0 and _joined(text, ends[i], a, words[i])
    after = j < len(starts) and _joined(text, b, starts[j], words[j])
    if before and i and _joined(text, ends[i - 1], starts[i], words[i - 1]):
        out.append(f"l:{words[i - 1]} {words[i]}")
    if after and j + 1 < len(starts) and _joined(text, ends[j], starts[j + 1], words[j + 1]):
        out.append(f"r:{words[j]} {words[j + 1]}")
    if before and after:
        out.append(f"b:{words[i]} _ {words[j]}")
    return out


def ordinary(text: str, a: int, b: int) -> bool:
    """Whether a token is no identifier by its looks: short, a plain lower-case word, a small number, a sentence's first word."""
    token = text[a:b]
    if len(token) < LEAST_CHARS or (token.isalpha() and token.islower()) or (token.isdigit() and len(token) < 5):
        return True
    before = text[max(0, a - MOST_GAP) : a].rstrip(" \"'(")
    return token.istitle() and (not before or before[-1] in ".!?\n")


def slots(text: str, taken: list[tuple[int, int, int]], at: tuple[list[int], list[int], list[str]]) -> list[tuple[int, int, int]]:
    """(start, end, kind): the entities in taken, and the tokens that meet none of them, strangers or ordinary words."""
    out, k, reach = [], 0, 0
    for a, b in zip(at[0], at[1]):
        while k < len(taken) and taken[k][0] <= a:
            start, kind, end = taken[k]
            out.append((start, end, kind))
            reach, k = max(reach, end), k + 1
        if reach <= a and (k == len(taken) or b <= taken[k][0]):
            out.append((a, b, ORDINARY if ordinary(text, a, b) else STRANGER))
    return out + [(start, end, kind) for start, kind, end in taken[k:]]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that may be identifiers, outside taken."""
    return [(a, b) for a, b, kind in slots(text, taken, tokens(text)) if kind == STRANGER]


def _seeds(batches):
    """(pattern, instance, rule): patterns around base entities, once a batch."""
    for b in batches:
        found = set()
        for text in b.column("text"):
            text = text.as_py()
            for a, kind, e in base_spans(text):
                for p in patterns_at(text, a, e, tokens(text, max(0, a - _REACH), min(len(text), e + _REACH))):
                    found.add((p, text[a:e].lower(), kind))
        yield _edges(found)


class Screen:
    """Tells texts that can hold one of the patterns, by the pairs of words that these ask for, from the many that can't."""

    def __init__(self, patterns):
        split = [(p[0], *p[2:].split(" ")[:: 2 if p[0] == "b" else 1]) for p in patterns]  # words hold no blanks
        self.near = {(x, y) for kind, x, y in split if kind != "b"}
        self.wide = {(x, y) for kind, x, y in split if kind == "b"}

    def passes(self, words: list[str]) -> bool:
        return not self.near.isdisjoint(zip(words, words[1:])) or any(not self.wide.isdisjoint(zip(words, words[k:])) for k in (1, 2) if self.wide)


def _words(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text)]


def _around_entities(text: str, base: list[tuple[int, int, int]]):
    for a, kind, e in base:
        yield a, e, kind, patterns_at(text, a, e, tokens(text, max(0, a - _REACH), min(len(text), e + _REACH)))


def _in_patterns(sent):
    """(pattern, instance, rule) of the slots in the sent patterns, once a batch.

    sent: the ordinary words that a pattern may hold and still become confident; with more of them the task has proof
    that it can't, and looks for it no more.
    """

    def batches(it):
        active, words_of = dict(sent.value), {}
        screen = Screen(active)
        for b in it:
            found = set()
            for text in b.column("text") if active else ():
                text = text.as_py()
                base = base_spans(text)
                if screen.passes(_words(text)):
                    at = tokens(text)
                    hits = ((a, e, kind, patterns_at(text, a, e, at)) for a, e, kind in slots(text, base, at))
                else:  # an entity of several tokens may still part the words of a pattern
                    hits = _around_entities(text, base)
                proved = 0
                for a, e, kind, patterns in hits:
                    for p in patterns:
                        if p in active:
                            found.add((p, text[a:e].lower(), kind))
                            if kind == ORDINARY:
                                held = words_of.setdefault(p, set())
                                held.add(text[a:e].lower())
                                if len(held) > active[p]:
                                    del active[p], words_of[p]
                                    proved += 1
                if proved:
                    screen = Screen(active)
            yield _edges(found)

    return batches


def _of_instances(sent):
    """(pattern, instance, rule) of the strangers among the sent instances, once a batch."""

    def batches(it):
        instances = sent.value
        for b in it:
            found = set()
            for text in b.column("text"):
                text = text.as_py()
                if not instances.isdisjoint(_words(text)):
                    at = tokens(text)
                    for a, e, kind in slots(text, base_spans(text), at):
                        if kind == STRANGER and text[a:e].lower() in instances:
                            found.update((p, text[a:e].lower(), kind) for p in patterns_at(text, a, e, at))
            yield _edges(found)

    return batches


def _edges(found) -> pa.RecordBatch:
    pattern, instance, rule = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(pattern, pa.string()), pa.array(instance, pa.string()), pa.array(rule, pa.int32())], names=["pattern", "instance", "rule"])


EDGE = "pattern string, instance string, rule int"


def _blocks(rows: DataFrame, column: str):
    """rows in parts of about BLOCK, so that one pass over the documents holds a bounded broadcast."""
    n = -(-rows.count() // BLOCK)
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64(column), F.lit(n)) == k) for k in range(n)]


def in_patterns(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, rule) of all slots in patterns (pattern, seeds), without those proved to be hopeless.

    A pattern with more ordinary words than its seeds / CONFIDENT leave room for can't become confident and is left out.
    """
    spark, out = texts.sparkSession, None
    room = F.greatest(F.col("seeds") / CONFIDENT - F.col("seeds") - SHRINK, F.lit(0.0))
    limits = patterns.select("pattern", room.alias("room"))
    for block in _blocks(limits, "pattern"):
        sent = spark.sparkContext.broadcast({r["pattern"]: r["room"] for r in block.toLocalIterator()})  # about BLOCK patterns
        part = texts.select("text").mapInArrow(_in_patterns(sent), EDGE)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], EDGE)
    out = staged(out.distinct(), "pii-slots")
    words = out.where(F.col("rule") == ORDINARY).groupBy("pattern").agg(F.count(F.lit(1)).alias("words"))
    hopeless = staged(words.join(limits, "pattern").where("words > room").select("pattern"), "pii-hopeless")
    return out.join(lookup(hopeless, hopeless.count()), "pattern", "left_anti")


def of_instances(texts: DataFrame, instances: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, rule) of all slots that hold one of the instances."""
    spark, out = texts.sparkSession, None
    for block in _blocks(instances, "instance"):
        sent = spark.sparkContext.broadcast(frozenset(r["instance"] for r in block.select("instance").toLocalIterator()))  # about BLOCK instances
        part = texts.select("text").mapInArrow(_of_instances(sent), EDGE)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], EDGE) if out is None else out.distinct()


def scored_patterns(occurrences: DataFrame, known: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confidences of patterns (pattern, rule, seeds, conf) and strangers (instance, rule, p), staged.

    occurrences: pattern, instance and rule (a kind's number, STRANGER or ORDINARY); known: (instance, rule, p), strangers
    that earlier rounds have found. A pattern's confidence of a kind is its known instances, weighted, divided by them,
    its instances of other kinds, its ordinary words, DOUBT times what strangers lack in confidence, and SHRINK.
    """
    edges = occurrences.groupBy("pattern", "instance").agg(F.max("rule").alias("rule"))
    if known is None:
        known = occurrences.sparkSession.createDataFrame([], "instance string, rule int, p double")
    named = known.select("instance", F.col("rule").alias("known"), "p")
    edges = edges.join(named, "instance", "left").withColumn("known", F.when(F.col("rule") >= 0, F.col("rule")).when(F.col("rule") == STRANGER, F.col("known")))
    edges = staged(edges.withColumn("weight", F.when(F.col("rule") >= 0, 1.0).otherwise(F.col("p"))).drop("p"), "pii-edges")
    total = edges.groupBy("pattern").agg(F.sum(F.when(F.col("known").isNotNull(), F.col("weight")).when(F.col("rule") == ORDINARY, 1.0).otherwise(0.0)).alias("sure"))
    support = edges.where("known is not null").groupBy("pattern", F.col("known").alias("rule")).agg(F.sum("weight").alias("seeds"))
    base = staged(support.join(total, "pattern"), "pii-patterns")
    strangers = staged(edges.where(f"rule = {STRANGER} and known is null").select("pattern", "instance"), "pii-strangers")
    conf = base.withColumn("conf", F.col("seeds") / (F.col("sure") + SHRINK))
    for k in range(rounds + 1):
        miss = conf.select("pattern", "rule", F.log1p(-F.least(F.col("conf"), F.lit(0.999))).alias("miss"))
        trust = strangers.join(miss, "pattern").groupBy("instance", "rule").agg((1 - F.exp(F.sum("miss"))).alias("p"))
        trust = staged(trust, "pii-trust")
        if k == rounds:
            return conf, trust
        doubt = strangers.join(trust, "instance").groupBy("pattern", "rule").agg(F.sum(1 - F.col("p")).alias("doubt"))
        conf = base.join(doubt, ["pattern", "rule"], "left").withColumn("conf", F.col("seeds") / (F.col("sure") + DOUBT * F.coalesce("doubt", F.lit(0.0)) + SHRINK)).drop("doubt")
        conf = staged(conf, "pii-confidence")


def _best(conf: DataFrame) -> DataFrame:
    good = conf.where((F.col("seeds") >= LEAST_SEEDS) & (F.col("conf") >= CONFIDENT))
    return good.groupBy("pattern").agg(F.max_by(F.struct("rule", "conf"), F.struct("conf", -F.col("rule"))).alias("b")).select("pattern", "b.rule", "b.conf")


def confident_patterns(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, rule): patterns whose instances are with high confidence of one kind. occurrences: pattern, instance, rule."""
    return _best(scored_patterns(occurrences, rounds=rounds)[0]).select("pattern", "rule")


def bootstrap(docs: DataFrame, rounds: int = BOOTSTRAPS) -> DataFrame:
    """(pattern, rule, conf) of the confident patterns, staged. docs: text, without nulls.

    Scans the documents once for the contexts of base entities, and in each round once for what stands in new patterns
    and once for where new instances stand. Ends when a round induces no new pattern or finds no new instance.
    """
    spark = docs.sparkSession
    induced = staged(docs.select("text").mapInArrow(_seeds, EDGE).distinct(), "pii-seeds")
    sizes = {r["rule"]: r["count"] for r in induced.select("instance", "rule").distinct().groupBy("rule").count().collect()}  # a row a kind
    least = F.lit(float(LEAST_SEEDS))
    for rule, n in sorted(sizes.items()):
        least = F.when(F.col("rule") == rule, max(float(LEAST_SEEDS), LEAST_SHARE * n)).otherwise(least)
    known = spark.createDataFrame([], "instance string, rule int, p double")
    edges, asked = spark.createDataFrame([], EDGE), spark.createDataFrame([], "pattern string")
    best = spark.createDataFrame([], "pattern string, rule int, conf double")
    for k in range(rounds):
        vouched = induced.join(known.select("instance", F.col("rule").alias("kind"), "p"), "instance", "left")
        kind, weight = F.when(F.col("rule") >= 0, F.col("rule")).otherwise(F.col("kind")), F.when(F.col("rule") >= 0, 1.0).otherwise(F.col("p"))
        likely = vouched.groupBy("pattern", kind.alias("rule")).agg(F.sum(weight).alias("seeds")).where(F.col("seeds") >= least)
        new = staged(likely.groupBy("pattern").agg(F.max("seeds").alias("seeds")).join(asked, "pattern", "left_anti"), "pii-new")
        if new.isEmpty():
            break
        asked = asked.unionByName(new.select("pattern"))
        edges = staged(edges.unionByName(in_patterns(docs, new)), "pii-met")
        best = staged(_best(scored_patterns(edges, known)[0]), "pii-best")
        if k + 1 == rounds:
            break
        found = staged(_discovered(edges, best).join(known.select("instance"), "instance", "left_anti"), "pii-found")
        if found.isEmpty():
            break
        known = known.unionByName(found)
        induced = staged(induced.unionByName(of_instances(docs, found)).distinct(), "pii-induced")
    return best


def _discovered(edges: DataFrame, best: DataFrame) -> DataFrame:
    """(instance, rule, p): strangers in confident patterns, by the noisy-or of these, of their likeliest kind."""
    by = edges.where(F.col("rule") == STRANGER).select("pattern", "instance").join(best, "pattern")
    p = by.groupBy("instance", "rule").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999)))))).alias("p"))
    return p.groupBy("instance").agg(F.max_by(F.struct("rule", "p"), F.struct("p", -F.col("rule"))).alias("b")).select("instance", "b.rule", "b.p")


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.int32()), ("conf", pa.float64())]))
_HIT_ROWS = "doc_id long, text string, hits array<struct<start:int,end:int,rule:int,conf:double>>"


def _hits(text: str, base: list[tuple[int, int, int]], known: dict[str, tuple[int, float]], screen: Screen):
    """(start, end, rule, conf) of the strangers in known patterns, by the likeliest of them."""
    at = tokens(text) if known and screen.passes(_words(text)) else ([], [], [])
    for a, e, kind in slots(text, base, at):
        hits = [known[p] for p in patterns_at(text, a, e, at) if p in known] if kind == STRANGER else []
        if hits:
            yield (a, e, *max(hits, key=lambda h: (h[1], -h[0])))


def _hit_batches(known_patterns):
    """Adds a block of patterns' hits to those of blocks before."""

    def batches(it):
        known = known_patterns.value
        screen = Screen(known)
        for b in it:
            for doc, text, before in zip(b.column("doc_id"), b.column("text"), b.column("hits")):
                hits = before.as_py() + [dict(zip(("start", "end", "rule", "conf"), h)) for h in _hits(text.as_py(), base_spans(text.as_py()), known, screen)]
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([text.as_py()]), pa.array([hits], _HITS)], names=["doc_id", "text", "hits"])

    return batches


def _named(known_patterns):
    """The answer for each text: base spans, and what the last block of patterns, or a block before, names."""

    def batches(it):
        known = known_patterns.value
        screen = Screen(known)
        names = (*KINDS, *(f"ctx_{kind}" for kind in KINDS))
        for b in it:
            for k in range(0, b.num_rows, 512):
                part, rows = b.slice(k, 512), []
                earlier = part.column("hits").to_pylist() if "hits" in part.schema.names else [()] * part.num_rows
                for doc, text, hits in zip(part.column("doc_id").to_pylist(), part.column("text"), earlier):
                    base = every = base_spans(text.as_py())
                    if known:
                        likeliest: dict[tuple[int, int], tuple[float, int]] = {}
                        for a, e, rule, conf in [*((h["start"], h["end"], h["rule"], h["conf"]) for h in hits), *_hits(text.as_py(), base, known, screen)]:
                            likeliest[a, e] = max(likeliest.get((a, e), (0.0, 0)), (conf, -rule))
                        every = sorted(base + [(a, len(KINDS) - rule, e) for (a, e), (_, rule) in likeliest.items()])
                    line = [",".join(f"{names[kind]}:{a}:{e}" for a, kind, e in spans) for spans in (base, every)]
                    rows.append((doc, *[sum(kind == i for _, kind, _ in base) for i in range(len(KINDS))], *line))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2)], names=[f.split()[0] for f in _FOUND.split(", ")])

    return batches


def find(docs: DataFrame, rounds: int = BOOTSTRAPS) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_<kind>, base_spans and spans ("kind:start:end", by start, then kind).

    Offsets are code points, ends exclusive. Discovered spans have the kind "ctx_" and their likeliest pattern's kind (of
    equals the first), never overlap base ones or each other, and come after base ones of the same start. Texts of any
    length take time in proportion. Null texts are empty; rows without id and repeated rows count like others. Other
    columns are ignored. Empty in, empty out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    best = bootstrap(rows, rounds)
    blocks = max(1, -(-best.count() // BLOCK))
    for k in range(blocks):
        part = best.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        known = spark.sparkContext.broadcast({r["pattern"]: (r["rule"], r["conf"]) for r in part.toLocalIterator()})  # about BLOCK patterns
        if k + 1 == blocks:
            return rows.mapInArrow(_named(known), _FOUND)
        rows = rows if k else rows.withColumn("hits", F.expr("cast(array() as array<struct<start:int,end:int,rule:int,conf:double>>)"))
        rows = rows.mapInArrow(_hit_batches(known), _HIT_ROWS)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")
