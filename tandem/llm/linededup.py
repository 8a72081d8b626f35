"""Line deduplication: lines that many documents share stay only in the document with the largest id.

Built of DataFrame functions alone. Lines are exploded with their positions, normalised and hashed to 128 bits; row
counts per hash (pre-aggregated) screen the candidates, distinct documents are counted for those only, and each text is
put together again from the slices between its dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, fresh, join_lookup, lookup, staged, table, text_of

SPACE = "\x20\t\n\x0b\x0c\r"
KEY_CHARS, MIN_DOCS = 40, 5
#: Dropped positions up to which they are broadcast to the texts; beyond, texts are dealt out by document.
BROADCAST_POSITIONS = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, key_chars: int) -> DataFrame:
    """(doc_id, version, pos, h1, h2) of the lines whose key has key_chars code points; version tells texts of one id apart."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text_of()).alias("version"), F.posexplode(_lines(text_of())).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= key_chars).withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACE)))).where(F.char_length("key") >= key_chars)
    return keys.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_positions(docs: DataFrame, key_chars: int = KEY_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, version, pos) of the lines to drop."""
    hashed = staged(line_hashes(docs, key_chars), "lines-hashed")
    often = staged(hashed.groupBy("h1", "h2").count().where(F.col("count") >= min_docs).select("h1", "h2"), "lines-often")
    n = often.count()
    held = join_lookup(hashed, often, ["h1", "h2"], n, "doc_id", "left_semi").select("h1", "h2", "doc_id").distinct()
    shared = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    shared = staged(shared.select("h1", "h2", "keeper"), "lines-shared")
    return join_lookup(hashed, shared, ["h1", "h2"], shared.count(), "doc_id").where("doc_id <> keeper").select("doc_id", "version", "pos").distinct()


def dedup_lines(docs: DataFrame, key_chars: int = KEY_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with such lines gone from text, and n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of at least key_chars code
    points that occur in at least min_docs documents (distinct doc_id) lose all their lines but those of the largest
    doc_id. Other lines stay, joined by newlines; a text that loses all lines becomes empty. Null and empty texts have
    one empty line; a null text stays null. A row without doc_id counts for no key and keeps its lines. Repeated rows
    are one document and lose the same lines. Further columns pass through, but n_lines and n_dropped are replaced.
    """
    gone = staged(dropped_positions(docs.select("doc_id", "text"), key_chars, min_docs), "lines-gone")
    n = gone.count()
    own_id, own_version, places, mine = fresh(docs.columns, "ld_id", "ld_version", "ld_gone", "ld_v")
    per = gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("pos")).alias(places))
    per = per.select(F.col("doc_id").alias(own_id), F.col("version").alias(own_version), places)
    lines = _lines(text_of())
    kept_names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*kept_names).withColumn(mine, F.xxhash64(text_of())).join(lookup(per, n, BROADCAST_POSITIONS), (F.col("doc_id") == F.col(own_id)) & (F.col(mine) == F.col(own_version)), "left")
    edges = F.concat(F.array(F.lit(-1)), F.col(places), F.array(F.size(lines)))
    bounds = F.zip_with(F.slice(edges, F.lit(1), F.size(places) + 1), F.slice(edges, F.lit(2), F.size(places) + 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.flatten(F.transform(bounds, lambda x: F.slice(lines, x["a"] + 2, x["b"] - x["a"] - 1)))
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in kept_names]
    return joined.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           unnest(range(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)) as pos
    from documents),
keyed as (
    select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (
    select key, max(doc_id) as keeper from keyed where length(key) >= {KEY_CHARS}
    group by key having count(distinct doc_id) >= {MIN_DOCS}),
marked as (
    select doc_id, pos, line, coalesce(keeper <> doc_id, false) as gone from keyed left join shared using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
