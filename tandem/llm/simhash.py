"""SimHash near-duplicates: fingerprints linked through a Gray-order hierarchical index.

Fingerprints within `distance` bits are found exactly. Six bands of bits give fifteen pairs of bands; two fingerprints
that differ in at most four bits agree on two bands at least, so they share one of fifteen buckets. Each bucket is
searched by a Gray-order index: its fingerprints are sorted by Gray rank, sixteen neighbours form a node that keeps the
bits on which all its members agree (mask and pattern), nodes form nodes in turn, and a search drops a whole node as
soon as the differences accumulated on its mask exceed the distance. A bucket returns a spanning forest of its links,
never all pairs. Buckets of more than `split_over` fingerprints are dealt out again by pairs of six bands of the bits
that they don't share, up to LEVELS times: a bucket then shares so many bits that it can't hold more than 2 ** 13.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, lookup, staged, table, text_of
from .graph import components, min_labels

SEED, SHINGLE, DISTANCE = 42, 4, 4
FAN, SMALL, SPLIT_OVER, SLAB = 16, 256, 4096, 1 << 18
#: Times that fingerprints are dealt to buckets: free bits fall from 64 to about 43, 29, 19 and 13.
LEVELS = 4
#: A fingerprint that more rows hold is joined by broadcast; there are at most rows / HOT_ROWS of these.
HOT_ROWS = 50_000
_LANES = np.uint64(0x0101010101010101)


def _shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: splits at ASCII white space, lowers A-Z
    n = len(words)
    if not n:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return [digest(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    return [digest(joined[a:b], SEED) for a, b in zip((ends - size)[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())]


def _majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The majority bits of each run of hashes; counts: the runs' lengths, all positive."""
    first = np.cumsum(counts) - counts
    parts = -(-counts // 255)  # at most 255 rows in a part: eight byte-wide counters fit a word
    part_first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(part_first, parts)
    at = np.repeat(first, parts) + within * 255
    out = np.zeros(len(counts), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, at)
        per = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), part_first, axis=0)
        for byte in range(8):
            out |= (2 * per[:, byte] > counts).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def simhash(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints (uint64); no words: zero."""
    out, slab, counts, at = np.zeros(len(texts), np.uint64), [], [], []

    def flush():
        if slab:
            out[at] = _majority(np.array(slab, np.uint64), np.array(counts))
            slab.clear(), counts.clear(), at.clear()

    for i, text in enumerate(texts):
        if got := _shingle_hashes(text):
            slab.extend(got)
            counts.append(len(got))
            at.append(i)
            if len(slab) >= SLAB:
                flush()
    flush()
    return out


def _fingerprint_batches(batches):
    for b in batches:
        for k in range(0, b.num_rows, 512):
            part = b.slice(k, 512)
            fp = simhash(part.column("text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(fp)], names=["doc_id", "version", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp long): one row per row of docs, whatever its other columns; version is a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("version"), "text")
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, version long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Upper nodes over runs of Gray-sorted fingerprints: what all members of a node share, as a mask and a pattern."""

    def __init__(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """x: fingerprints; each run (starts, lengths) is one tree."""
        self.x, self.levels = x, []
        land, lor, n = x, x, lengths
        while True:
            nodes = -(-n // FAN)
            first = np.cumsum(nodes) - nodes
            within = np.arange(nodes.sum()) - np.repeat(first, nodes)
            at = np.repeat(starts, nodes) + within * FAN
            end = np.minimum(at + FAN, np.repeat(starts + n, nodes))
            land, lor = np.bitwise_and.reduceat(land, at), np.bitwise_or.reduceat(lor, at)
            mask = ~(land ^ lor)
            self.levels.append((mask, land & mask, at, end))
            starts, n = first, nodes
            if (n == 1).all():
                return

    def near(self, q: np.ndarray, root: np.ndarray, distance: int, label: np.ndarray | None = None):
        """Links (i, j), i in q and j > i, within distance. label: nodes wholly of the searcher's own part are dropped."""
        node = root
        low = high = None
        if label is not None:
            low, high, spans = label, label, []
            for _, _, at, _ in self.levels:
                low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
                spans.append((low, high))
        for k in range(len(self.levels) - 1, -1, -1):
            mask, pattern, at, end = self.levels[k]
            keep = np.bitwise_count((self.x[q] ^ pattern[node]) & mask[node]) <= distance
            if label is not None:
                lo, hi = spans[k][0][node], spans[k][1][node]
                keep &= (lo != hi) | (lo != label[q])
            q, node = q[keep], node[keep]
            fan = end[node] - at[node]
            below = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(at[node], fan)
            q, node = np.repeat(q, fan), below
        keep = (node > q) & (np.bitwise_count(self.x[q] ^ self.x[node]) <= distance)
        return q[keep], node[keep]


def _links(bucket: np.ndarray, x: np.ndarray, ident: np.ndarray, distance: int):
    """A spanning forest of the links within each bucket, as pairs of ids."""
    order = np.lexsort((gray_rank(x), bucket))
    bucket, x, ident = bucket[order], x[order], ident[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    lengths = np.diff(np.r_[starts, len(x)])
    label = np.arange(len(x))
    some = (lengths > 1) & (lengths <= SMALL)
    if some.any():
        s, n = starts[some], lengths[some]
        index = GrayIndex(x, s, n)
        q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
        root = np.repeat(np.arange(len(s)), n)
        for k in range(0, len(q), SLAB // SMALL * 16):
            part = slice(k, k + SLAB // SMALL * 16)
            label = min_labels(len(x), *index.near(q[part], root[part], distance), label)
    for s, n in zip(starts[lengths > SMALL], lengths[lengths > SMALL]):
        own = x[s : s + n]
        index = GrayIndex(own, np.array([0]), np.array([n]))
        close = np.flatnonzero(np.bitwise_count(own[1:] ^ own[:-1]) <= distance)
        part = min_labels(n, close, close + 1)
        step = max(64, SLAB * 8 // n)
        for k in range(0, n, step):
            q = np.arange(k, min(n, k + step))
            part = min_labels(n, *index.near(q, np.zeros(len(q), np.int64), distance, part), part)
        label[s : s + n] = part + s
    moved = label != np.arange(len(x))
    return ident[label[moved]], ident[moved]


def _link_batches(batches):
    """Rows come sorted by bucket; the last, perhaps unfinished bucket of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table):
        u, v = _links(t["bucket"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["ident"].to_numpy(), DISTANCE)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("bucket").to_numpy()
        if held and held[-1].column("bucket")[0].as_py() == key[-1] and key[0] == key[-1]:
            held.append(b)
            continue
        cut = int(np.searchsorted(key != key[-1], False)) if key[0] == key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
        yield done(pa.Table.from_batches([*held, b.slice(0, cut)]))
        held = [b.slice(cut)]
    if held:
        yield done(pa.Table.from_batches(held))


def _pairs_of_bands(bits: list[int]) -> list[int]:
    """Masks of the fifteen pairs of six bands of the given bits; what differs in four bits agrees on one of them."""
    bands = [sum(1 << i for i in part.tolist()) for part in np.array_split(bits, 6)]
    return [a | b for a, b in combinations(bands, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(_signed(mask)).alias("mask"), F.xxhash64(F.lit("a"), F.lit(m), F.col("fp").bitwiseAND(F.lit(_signed(mask)))).alias("bucket")) for m, mask in enumerate(masks)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value, by multiplications and shifts."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _refined(batches):
    """Each row once for each pair of bands of the bits that its bucket leaves free: ident, fp, mask and bucket anew."""
    for b in batches:
        ident, fp, mask, bucket = (b.column(c).to_numpy() for c in ("ident", "fp", "mask", "bucket"))
        for shared in np.unique(mask):  # at most 15 a level before, each level by 15
            at = mask == shared
            x, own = fp[at].view(np.uint64), _mixed(bucket[at].view(np.uint64))
            for k, sub in enumerate(_pairs_of_bands([i for i in range(64) if not int(shared) >> i & 1])):
                new = _mixed(own + _mixed((x & np.uint64(sub)) + np.uint64(k + 1)))
                wider = np.full(len(x), _signed((int(shared) & ((1 << 64) - 1)) | sub), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ident[at]), pa.array(fp[at]), pa.array(wider), pa.array(new.view(np.int64))], names=["ident", "fp", "mask", "bucket"])


def links(points: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """Edges (u, v) of ids whose fingerprints link, enough to join all that are linked. points: ident long, fp long, each fp once."""
    dealt = points.select("ident", "fp", F.explode(_buckets(_pairs_of_bands(list(range(64))))).alias("b")).select("ident", "fp", "b.mask", "b.bucket")
    light = None
    for level in range(LEVELS):
        heavy = staged(dealt.groupBy("bucket").count().where(F.col("count") > split_over).select("bucket"), "simhash-heavy")
        n = heavy.count() if level + 1 < LEVELS else 0
        part = (dealt.join(lookup(heavy, n), "bucket", "left_anti") if n else dealt).select("bucket", "fp", "ident")
        light = part if light is None else light.unionByName(part)
        if not n:
            break
        again = dealt.join(lookup(heavy, n), "bucket", "left_semi").select("ident", "fp", "mask", "bucket")
        dealt = staged(again.mapInArrow(_refined, "ident long, fp long, mask long, bucket long"), "simhash-refined")
    return light.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link_batches, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp, component_id) for every row of docs (doc_id, text); other columns are ignored.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. component_id is the
    smallest doc_id reachable through links. A row without doc_id gets its fingerprint's component, but joins none
    together; it is null if no row with an id shares the fingerprint. Repeated rows stay repeated. Empty in, empty out.
    """
    fps = staged(fingerprints(docs), "simhash-fps")
    parts = _parts(fps)
    hot = parts.where(F.col("n") > HOT_ROWS).select("fp", "component_id")
    if hot.isEmpty():
        joined = fps.join(parts.select("fp", "component_id"), "fp", "left")
    else:  # at most rows / HOT_ROWS of them; the rest has no key that fills a task
        rest = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(parts.where(F.col("n") <= HOT_ROWS).select("fp", "component_id"), "fp", "left")
        joined = fps.join(F.broadcast(hot), "fp").unionByName(rest)
    return joined.select("doc_id", "version", "fp", "component_id")


def _parts(fps: DataFrame) -> DataFrame:
    """Each fingerprint of a row with an id: fp, n rows, first (doc_id, version), root, component_id and the component's first row.

    Fingerprints, not ids, are the nodes that links join, so texts that share an id are not taken for one.
    """
    points = staged(fps.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "version")).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-points")
    root = components(links(points.select(F.col("fp").alias("ident"), "fp")), "simhash-components")
    rooted = staged(points.join(root, points["fp"] == root["node"], "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    return staged(rooted.join(least, "root").select("fp", "n", "root", "kept", F.col("kept.doc_id").alias("component_id")), "simhash-parts")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near duplicates: that of the smallest doc_id, of its texts the one of smallest hash.

    Two texts under one id stay both if they aren't near. A row without id goes if its group has one with an id, and
    stays otherwise. Of rows that repeat both id and text, one stays. Columns pass through, whatever their names.
    """
    fps = staged(fingerprints(docs), "simhash-fps")
    parts = _parts(fps)
    kept = staged(parts.select("root", "kept").distinct().select("kept.doc_id", "kept.version"), "simhash-kept")
    own, version = fresh(docs.columns, "id", "version")
    named = kept.select(F.col("doc_id").alias(own), F.col("version").alias(version))
    rows = fps.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    key = [F.col("doc_id").cast("long") == F.col(own), F.xxhash64(text_of()) == F.col(version)]
    n = kept.count()
    texts = staged(fps.where("doc_id is not null").groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n")), "simhash-texts")
    gone = staged(texts.join(kept, ["doc_id", "version"], "left_anti").select(F.col("doc_id").alias(own), F.col("version").alias(version)), "simhash-gone")
    some = gone.count()
    # Whichever list is short enough to be sent to the rows is used; beyond, the shorter one is shuffled.
    if some <= n:
        out = docs.where("doc_id is not null").join(lookup(gone, some), key, "left_anti")
    else:
        out = docs.where("doc_id is not null").join(lookup(named, n), key, "left_semi")
    twins = staged(texts.where("n > 1").join(kept, ["doc_id", "version"], "left_semi").select(F.col("doc_id").alias(own), F.col("version").alias(version)), "simhash-twins")
    doubled = twins.count()
    if doubled:
        pair = out.join(lookup(twins, doubled), key, "left_semi")
        single = out.join(lookup(twins, doubled), key, "left_anti")
        out = single.unionByName(pair.withColumn(version, F.xxhash64(text_of())).dropDuplicates(["doc_id", version]).drop(version))
    if rows[0] > rows[1]:  # rows without id
        lone = staged(fps.where("doc_id is null").select("version", "fp").distinct().join(parts.select("fp"), "fp", "left_anti").select(F.col("version").alias(version)), "simhash-lone")
        out = out.unionByName(docs.where("doc_id is null").join(lookup(lone, lone.count()), F.xxhash64(text_of()) == F.col(version), "left_semi"))
    return out


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
