"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are dealt by a seeded hash into shards, each shard is a stream of words in seeded order, and the
stream is cut into blocks of equal length (to a word). Blocks go to shards by the highest quotients votes / (2 * seats +
1), where a shard's votes are the blocks that its part of the target asks for; a shard with n blocks and quota q takes
every block q // n times and q % n seeded blocks once more.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import WORD, fresh, join_lookup, staged, table, text_of

WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3
SEED = 20240607
#: A shard has about this many documents, unless its source would then have more than MOST_SHARDS.
SHARD_DOCS, MOST_SHARDS = 4096, 1024
#: Words in a block: a share of the mean source, within these bounds.
BLOCK_SHARE, LEAST_BLOCK, MOST_BLOCK = 2000, 16, 1024
_WORDS = re.compile(WORD)


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; none above most times its size, the excess shared again by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        open_ -= set(over)
        left -= sum(out[i] for i in over)
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 * seats + 1); none gets more than its most. Ties go to the first.

    All but about two seats a party are dealt at once, by rounded-down shares less one; the rest goes seat by seat, and
    a seat moves as long as a party's next quotient is higher than another's last. That leaves the highest quotients.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    won = [min(m, max(0, math.floor(v * seats / total) - 1)) for v, m in zip(votes, most)]
    heap = [(-v / (2 * w + 1), i) for i, (v, w, m) in enumerate(zip(votes, won, most)) if w < m and v > 0]
    heapq.heapify(heap)
    left = seats - sum(won)
    while heap and left > 0:
        _, i = heapq.heappop(heap)
        won[i] += 1
        left -= 1
        if won[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    v, w, m = np.array(votes, float), np.array(won), np.array(most)
    while True:
        ahead, last = np.where(w < m, v / (2 * w + 1), -1.0), np.where(w > 0, v / np.maximum(1, 2 * w - 1), np.inf)
        i, j = int(ahead.argmax()), int(last.argmin())
        if ahead[i] <= last[j]:
            return w.tolist()
        w[i] += 1
        w[j] -= 1


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _stride(n: int) -> int:
    """A step coprime to n near the golden section: its multiples visit all blocks evenly."""
    a = max(1, round(n * 0.6180339887))
    while math.gcd(a, n) != 1:
        a += 1
    return a


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """A row per row of docs (doc_id, source, text): doc_id, version, size, source_size, target and what to take.

    What to take: begin (first word's place in its shard's stream), words and blocks (of the shard; block b is from
    b * words // blocks to the next), repeats (times that every block is taken), extra, stride, offset (block b is taken
    once more if (stride * b + offset) % blocks < extra).
    """
    spark = docs.sparkSession
    sized = staged(docs.select("doc_id", "source", F.xxhash64(text_of()).alias("version"), n_words(text_of()).alias("size")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()  # a row per source
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    block = min(MOST_BLOCK, max(LEAST_BLOCK, sum(sizes) // (BLOCK_SHARE * max(1, len(found)))))
    of_source = [(r["source"], r["size"], t, min(MOST_SHARDS, -(-r["docs"] // SHARD_DOCS))) for r, t in zip(found, goal)]
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("shards", T.LongType())])
    dealt = join_lookup(sized, spark.createDataFrame(of_source, schema), ["source"], len(found), "version")
    dealt = dealt.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "version")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "version"), "shards"))
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect()  # at most MOST_SHARDS rows a source
    cells.sort(key=lambda r: (r["source"] is None, r["source"] or "", r["shard"]))
    by_source = {s: (size, t) for s, size, t, _ in of_source}
    blocks = [-(-r["size"] // block) for r in cells]
    votes = [by_source[r["source"]][1] * n / max(1, by_source[r["source"]][0]) for r, n in zip(cells, blocks)]
    quota = sainte_lague(votes, round(sum(votes)), [MOST_REPEATS * n for n in blocks])
    rng = np.random.default_rng(seed)
    rows = [(r["source"], r["shard"], q // max(1, n), q % max(1, n), max(1, n), _stride(max(1, n)), int(rng.integers(max(1, n))), r["size"]) for r, n, q in zip(cells, blocks, quota)]
    fields = [T.StructField("source", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("shard", "repeats", "extra", "blocks", "stride", "offset", "words")]]
    quotas = spark.createDataFrame(rows, T.StructType(fields))
    placed = dealt.withColumn("begin", F.coalesce(F.sum("size").over(Window.partitionBy("source", "shard").orderBy("order", "doc_id", "version").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = join_lookup(placed, quotas, ["source", "shard"], len(rows), "version")
    return placed.drop("order", "shard", "shards")


def _extra_blocks() -> Column:
    """The blocks taken once more that a document meets, as (first word, end) within the document."""
    words, blocks = F.greatest("words", F.lit(1)), F.col("blocks")
    div = lambda a, b: F.call_function("div", a, b)
    holding = lambda place: div((place + 1) * blocks - 1, words)  # noqa: E731  the block with the word at this place
    last = F.col("begin") + F.greatest(F.col("size"), F.lit(1)) - 1
    chosen = F.filter(F.sequence(holding(F.col("begin")), holding(last)), lambda b: (b * F.col("stride") + F.col("offset")) % blocks < F.col("extra"))
    bound = lambda b: F.greatest(F.lit(0), F.least(F.col("size"), div(b * words, blocks) - F.col("begin")))
    return F.transform(chosen, lambda b: F.struct(bound(b).alias("a"), bound(b + 1).alias("b")))


def taken() -> Column:
    extra = F.aggregate(_extra_blocks(), F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return F.col("repeats") * F.col("size") + extra


def _slices(times: str, runs_name: str):
    """For each row: its whole text, as often as the column `times` says, then the runs of words in its extra blocks."""

    def slices(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                at, texts = [], []
                for i, (text, repeats, runs) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", times, runs_name)))):
                    found = [text] * repeats
                    if runs:
                        merged = []
                        for r in runs:
                            if merged and merged[-1][1] == r["a"]:
                                merged[-1][1] = r["b"]
                            elif r["b"] > r["a"]:
                                merged.append([r["a"], r["b"]])
                        spans = [m.span() for m in _WORDS.finditer(text)] if merged else []
                        found += [text if b - a == len(spans) else text[spans[a][0] : spans[b - 1][1]] for a, b in merged]
                    at += [i] * len(found)
                    texts += found
                rows = part.take(pa.array(at, pa.int64()))
                names = [c for c in part.schema.names if c not in (times, runs_name)]
                new = {"text": texts, "n_chars": list(map(len, texts))}
                columns = [pa.array(new[c], part.schema.field(c).type) if c in new else rows.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return slices


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: a document taken more than once is repeated, of one taken in part the taken words stay.

    Texts without words (null ones too) are never taken. Rows that agree in id, source and text are planned once each and
    numbered by a seeded hash of all their columns, so reruns give each of them the same part; together they give what
    the plan takes. Very long texts are cut at words. Columns pass through, whatever their names; n_chars, where there is
    one, follows the text. Empty in, empty out.
    """
    schema = docs.schema
    doc, source, version, times, runs, number, own, mine = fresh(docs.columns, "mx_doc_id", "mx_source", "mx_version", "mx_repeats", "mx_runs", "mx_twin", "mx_v", "mx_t")
    chosen = plan(docs.select("doc_id", "source", "text"), weights, seed).where("size > 0")
    chosen = chosen.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("version").alias(version), F.col("repeats").alias(times), _extra_blocks().alias(runs))
    chosen = chosen.withColumn(number, F.row_number().over(Window.partitionBy(doc, source, version).orderBy(times, runs)))
    chosen = chosen.where((F.col(times) > 0) | (F.size(runs) > 0))
    again = staged(chosen.groupBy(doc, source, version).agg(F.max(number).alias("n")).where("n > 1"), "mix-twins")
    texts = docs.withColumn(own, F.xxhash64(text_of()))
    if again.count():  # rows that agree: number them on this side too
        whole = F.to_json(F.struct(*docs.columns))
        texts = texts.withColumn(mine, F.row_number().over(Window.partitionBy("doc_id", "source", own).orderBy(F.xxhash64(F.lit(seed), whole), whole)))
    else:
        texts = texts.withColumn(mine, F.lit(1))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(version)) & (F.col(mine) == F.col(number))
    joined = texts.join(chosen.hint("shuffle_hash"), same).drop(doc, source, version, own, mine, number)
    return joined.mapInArrow(_slices(times, runs), schema)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", taken().alias("taken"))
