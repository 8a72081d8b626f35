"""Secret scans over an incremental ledger of blobs.

Every version of a document is addressed by the SHA-256 of its text. The ledger, a folder of Parquet parts under
numbered manifests, tells which pairs of blob and rule version were scanned before; an update scans only unseen pairs,
each blob once however many documents hold it, and findings are joined back to all of them. Built of DataFrame functions
alone: matches and the gaps between them come from regexp_extract_all and split, and running sums of their lengths give
code point offsets.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import join_lookup, lookup, scratch, staged, table, text_of


@dataclass(frozen=True)
class Rule:
    """kind; Java regular expression; the least code points of `group`; a literal that every match holds, if any."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    holds: str | None = None
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"

    @property
    def digest(self) -> str:
        return hashlib.sha256(repr((self.pattern, self.least, self.group)).encode()).hexdigest()


#: Rules in the order of kinds; the first three are the base.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 16, holds="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 32),  # a run that is shorter fails as a whole, so the bound can be in the pattern
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, holds="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40, holds="gh"),
)
BASE = ("assign", "access", "hex")


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _matches(rule: Rule, n: int, text: Column) -> Column:
    """An array of (rule's number, place, gap before, length, whether it counts), one for each match."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    rows = F.transform(
        F.arrays_zip(found.alias("m"), held.alias("h"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")),
        lambda x, i: F.struct(F.lit(n).alias("rule"), i.alias("i"), F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("length"), (F.char_length(x["h"]) >= rule.least).alias("ok")),
    )
    return F.when((F.contains(text, F.lit(rule.holds)) if rule.holds else F.lit(True)) & text.rlike(rule.pattern), rows)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, start, end) of the findings in blobs (blob, text and, perhaps, todo: the names of the rules to apply)."""
    per_rule = []
    for n, rule in enumerate(rules):
        rows = _matches(rule, n, F.col("text"))
        per_rule.append(F.when(F.array_contains("todo", rule.name), rows) if "todo" in blobs.columns else rows)
    none = F.expr("cast(array() as array<struct<rule:int,i:int,gap:int,length:int,ok:boolean>>)")
    hits = blobs.select("blob", F.explode(F.concat(*[F.coalesce(x, none) for x in per_rule])).alias("x")).select("blob", "x.*")
    hits = hits.groupBy("blob", "rule", "i").agg(F.max("gap").alias("gap"), F.max("length").alias("length"), F.max("ok").alias("ok"))
    so_far = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = hits.withColumn("end", F.sum((F.col("gap") + F.col("length")).cast("long")).over(so_far))
    return ends.where("ok").select("blob", "rule", (F.col("end") - F.col("length")).alias("start"), "end")


_TABLES = {
    "versions": "doc_id long, blob binary, copies long",
    "seen": "blob binary, rule_name string",
    "findings": "blob binary, rule string, start long, end long",
    "blobs": "blob binary, text string",
}
#: Parts after which an update first writes the ledger anew as one.
MOST_PARTS = 32


class LedgerConflict(RuntimeError):
    """Another update of the same ledger was committed first; open it again and repeat."""


@dataclass
class Ledger:
    """A committed state of the ledger at path; later updates don't change it.

    versions: (doc_id, blob, copies), a row for each version, copies the times its first batch held it; seen: (blob,
    rule_name); findings: (blob, rule, start, end), by the rule's name with its version; blobs: (blob, text), if texts
    are kept. complete: rules that every blob was scanned with; batch: (doc_id, blob) of the last update's rows.
    """

    spark: SparkSession
    path: str
    number: int = 0
    parts: list[str] = field(default_factory=list)
    rules: dict[str, str] = field(default_factory=dict)
    complete: list[str] = field(default_factory=list)
    texts: bool = False
    batch: DataFrame | None = None

    def _read(self, name: str) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(*(f"{self.path}/parts/{p}/{name}" for p in self.parts))

    versions = property(lambda self: self._read("versions"))
    seen = property(lambda self: self._read("seen"))
    findings = property(lambda self: self._read("findings"))
    blobs = property(lambda self: self._read("blobs"))

    def _write(self, part: str, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/parts/{part}/{name}")

    def _commit(self, parts: list[str], rules: dict[str, str], complete: list[str], batch: DataFrame | None = None) -> Ledger:
        """The next state. Its manifest appears whole or not at all, by a rename that never replaces a file."""
        after = Ledger(self.spark, self.path, self.number + 1, parts, rules, complete, self.texts, batch)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs = jvm.org.apache.hadoop.fs
        draft, final = fs.Path(f"{self.path}/log/.draft-{uuid.uuid4().hex}"), fs.Path(f"{self.path}/log/{after.number:010d}.json")
        body = json.dumps({"parts": parts, "rules": rules, "complete": complete, "texts": self.texts})
        out = draft.getFileSystem(conf).create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        try:
            fs.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf).rename(draft, final, self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
        except Exception as error:
            draft.getFileSystem(conf).delete(draft, False)
            if final.getFileSystem(conf).exists(final):
                raise LedgerConflict(f"{self.path} already has a state {after.number}") from error
            raise
        return after

    def compacted(self) -> Ledger:
        """The same ledger as a single part, committed as its next state."""
        part = uuid.uuid4().hex
        for name in _TABLES:
            self._write(part, name, self._read(name))
        return self._commit([part], self.rules, self.complete)


def open_ledger(spark: SparkSession, path: str, texts: bool = False) -> Ledger:
    """The last committed state of the ledger at path, a new one if there is none.

    texts: whether a new ledger keeps the blobs' texts, so that later rules reach blobs of earlier updates. Parts that no
    manifest names (of updates that were cut off) are ignored.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    log = jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    fs = log.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    names = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
    if not names:
        return Ledger(spark, path, texts=texts)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{path}/log/{names[-1]}"))
    found = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return Ledger(spark, path, int(names[-1].removesuffix(".json")), **found)


def _first_rows(texts: DataFrame, batch: DataFrame, heads: DataFrame) -> DataFrame:
    """(blob, text) of the rows that stand for their blobs. Other rows are few as a rule, so the texts stay where they are."""
    several = staged(heads.where("n > 1").select("blob", "first"), "ledger-several")
    copies = join_lookup(batch, several, ["blob"], several.count(), "doc_id").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    copies = staged(copies.select(F.col("doc_id").alias("_id"), F.col("blob").alias("_blob")).distinct(), "ledger-copies")
    other = (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return texts.join(lookup(copies, copies.count()), other, "left_anti").select("blob", "text")


def update(docs: DataFrame, before: Ledger | None = None, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> Ledger:
    """The ledger after docs (doc_id, text), committed; only pairs of blob and rule version that before lacks are scanned.

    before: a state of the ledger; without it, that at path, or a scratch one without path. If the ledger keeps texts,
    blobs of earlier updates are scanned with rules new to them too. Null texts are empty blobs. A (doc_id, blob) that
    the ledger holds is not added again; rows that one batch repeats, and rows without id, are versions like others.
    Other columns are ignored. A rule changed under its old name and version raises a ValueError.
    """
    spark = docs.sparkSession
    before = before or open_ledger(spark, path or scratch(spark, "ledger"))
    known = before.rules | {}
    for rule in rules:
        if known.setdefault(rule.name, rule.digest) != rule.digest:
            raise ValueError(f"{rule.name} was another rule before: give the change a new version")
    if len(before.parts) >= MOST_PARTS:
        before = before.compacted()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("blob", blob_id(F.col("text")))
    batch = staged(texts.select("doc_id", "blob"), "ledger-batch")
    heads = staged(batch.groupBy("blob").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "ledger-heads")
    names, part = F.array(*[F.lit(r.name) for r in rules]), uuid.uuid4().hex
    versions = batch.groupBy("doc_id", "blob").agg(F.count(F.lit(1)).alias("copies"))
    if not before.parts:
        blobs, todo = _first_rows(texts, batch, heads), heads.select("blob", names.alias("todo"))
    else:
        held = before.versions.withColumnsRenamed({"doc_id": "_id", "blob": "_blob"})
        versions = versions.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("blob") == F.col("_blob")), "left_anti")
        every = heads.select("blob", "first", F.lit(True).alias("sent"))
        if before.texts:  # blobs of earlier updates, for rules that are new to them
            old = before.blobs.select("blob").join(heads, "blob", "left_anti")
            every = every.unionByName(old.select("blob", F.lit(None).cast("long").alias("first"), F.lit(False).alias("sent")))
        pairs = every.select("blob", "first", "sent", F.explode(names).alias("rule_name")).join(before.seen, ["blob", "rule_name"], "left_anti")
        todo = staged(pairs.groupBy("blob", "first", "sent").agg(F.collect_set("rule_name").alias("todo")), "ledger-todo")
        sent = todo.where("sent").select(F.col("blob").alias("_blob"), F.col("first").alias("_first"), "todo")
        own = (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_first"))
        blobs = texts.join(lookup(sent, sent.count()), own).select("blob", "text", "todo")
        if before.texts:
            blobs = blobs.unionByName(before.blobs.join(todo.where("not sent").select("blob", "todo"), "blob"))
    rule_name = F.element_at(names, F.col("rule") + 1)
    before._write(part, "findings", scan(blobs, rules).select("blob", rule_name.alias("rule"), "start", "end"))
    before._write(part, "seen", todo.select("blob", F.explode("todo").alias("rule_name")))
    before._write(part, "versions", versions)
    unknown = texts.limit(0) if not before.texts else texts if not before.parts else texts.join(before.blobs, "blob", "left_anti")
    before._write(part, "blobs", unknown.select("blob", "text").dropDuplicates(["blob"]))
    current = [r.name for r in rules if not before.parts or before.texts or r.name in before.complete]
    return before._commit([*before.parts, part], known, current, batch)


def by_version(ledger: Ledger, rules: tuple[Rule, ...] = RULES, of: DataFrame | None = None) -> DataFrame:
    """A row for each version: doc_id, n_<kind>, base_spans and spans ("kind:start:end", by start and kind, joined by commas).

    Only findings of these rules' versions count. n_<kind> is null where a blob was not scanned with that rule version.
    of: rows (doc_id, blob) to answer for, instead of the ledger's versions.
    """
    rows = ledger.versions.select("doc_id", "blob", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy") if of is None else of
    numbers = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.name), F.lit(n))])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    found = ledger.findings.where(F.col("rule").isin([r.name for r in rules])).withColumn("rule", F.element_at(numbers, F.col("rule")))
    span = F.struct("start", "rule", F.concat_ws(":", F.element_at(kinds, F.col("rule") + 1), "start", "end").alias("s"))
    base = [n for n, r in enumerate(rules) if r.kind in BASE]
    joined = lambda keep: F.array_join(F.transform(F.filter(F.sort_array("all"), keep), lambda x: x["s"]), ",")
    per_blob = found.groupBy("blob").agg(F.collect_list(span).alias("all"), *[F.count_if(F.col("rule") == n).alias(f"n_{r.kind}") for n, r in enumerate(rules)])
    per_blob = staged(per_blob.select("blob", *[f"n_{r.kind}" for r in rules], joined(lambda x: x["rule"].isin(base)).alias("base_spans"), joined(lambda x: F.lit(True)).alias("spans")), "ledger-blobs")
    n, size = per_blob.agg(F.count(F.lit(1)), F.sum(F.octet_length("base_spans") + F.octet_length("spans") + 64)).first()
    out = join_lookup(rows, per_blob, ["blob"], max(n, (size or 0) // 64), "doc_id", "left")
    counts = {f"n_{r.kind}": F.coalesce(f"n_{r.kind}", F.lit(0)) for r in rules}
    late = [r for r in rules if r.name not in ledger.complete]
    if late:  # some blobs may not have been scanned with these
        lacking = rows.select("blob").distinct().select("blob", F.explode(F.array(*[F.lit(r.name) for r in late])).alias("rule_name")).join(ledger.seen, ["blob", "rule_name"], "left_anti")
        lacking = staged(lacking.groupBy("blob").agg(F.collect_set("rule_name").alias("lacking")), "ledger-lacking")
        out = join_lookup(out, lacking, ["blob"], lacking.count(), "doc_id", "left")
        counts |= {f"n_{r.kind}": F.when(~F.coalesce(F.array_contains("lacking", r.name), F.lit(False)), counts[f"n_{r.kind}"]) for r in late}
    return out.select("doc_id", *[c.alias(name) for name, c in counts.items()], *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = update(table(spark, sf_dir, "documents"))
    found = by_version(ledger, of=ledger.batch)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _sql_hits(rule: int, pattern: str, value: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    select doc_id, {rule} as rule, unnest(range(1, len(m) + 1)) as i, m, v, g, {least} as least
    from (select doc_id, regexp_extract_all(t, '{quoted}') as m, regexp_extract_all(t, '{quoted}', {value}) as v,
                 string_split_regex(t, '{quoted}') as g from docs)"""


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
ORACLE_SQL = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
hits as ({" union all ".join((
    _sql_hits(0, "(" + _NAMES + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    _sql_hits(1, "AKIA[A-Z0-9]+", 0, 16),
    _sql_hits(2, "[0-9a-f]+", 0, 32),
    _sql_hits(3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    _sql_hits(4, "gh[pousr]_[A-Za-z0-9]+", 0, 40)))}),
spans as (
    select doc_id, rule, ['assign', 'access', 'hex', 'pem', 'github'][rule + 1] as kind,
           list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as a,
           length(m[i]) as n
    from hits where length(v[i]) >= least),
joined as (
    select doc_id, count(*) filter (where rule = 0) as n_assign, count(*) filter (where rule = 1) as n_access,
           count(*) filter (where rule = 2) as n_hex,
           string_agg(kind || ':' || a::bigint || ':' || (a + n)::bigint, ',' order by a, rule) filter (where rule < 3) as base,
           string_agg(kind || ':' || a::bigint || ':' || (a + n)::bigint, ',' order by a, rule) as spans
    from spans group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join joined using (doc_id)
"""
