"""Approximate nearest neighbours by largest inner product: inverted lists with an adaptive dimension scan.

Vectors get one more component that makes their lengths equal, so the largest inner product is the nearest point. Lists
are k-means cells of a bounded sample; how many lists a query probes is calibrated on that sample. Within a probed list
the randomly rotated vectors, stored in blocks of columns, are read block by block: after t of D columns a candidate is dropped if its partial
squared distance, scaled by D / t, exceeds the query's bound by more than the test's margin (1 + epsilon / sqrt(t))^2.
The bound is the distance of the k-th nearest sampled vector in the probed lists. Survivors are scored on the original
vectors in double precision. A query that is left with too few is searched again in all lists and without a bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import staged, table

K = 20
SEED = 20240613
#: The index is fitted on at most this many vectors, ...
SAMPLE = 20_000
#: ... has 2 * sqrt(rows) lists, but at most this many, ...
MOST_LISTS = 4096
#: ... and probes as many of them as give this recall between the sample's own vectors.
CALIBRATED_RECALL, CALIBRATION_QUERIES = 0.96, 256
#: Vectors of a list, and queries that probe it, that one task takes at once; longer lists of either are dealt out by a hash.
CHUNK, QUERY_CHUNK = 8192, 32_768
COLUMNS, EPSILON = 16, 2.1


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors: not null, not zero, all components present and finite."""
    out = []
    for v in column.to_pylist():
        if not v or any(c is None for c in v):
            out.append(None)
            continue
        x = np.array(v, np.float64)
        out.append(x if np.isfinite(x).all() and x.any() else None)
    return out


def _prepared(dtype: str):
    def batches(it):
        for b in it:
            kept = [(i, x) for i, x in zip(b.column("vec_id").to_pylist(), _vectors(b.column("embedding"))) if x is not None and i is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in kept], pa.int64()), pa.array([x.astype(dtype).tobytes() for _, x in kept], pa.binary()), pa.array([float(x @ x) for _, x in kept], pa.float64())],
                names=["vec_id", "vec", "norm2"],
            )

    return batches


def _matrix(values, dtype: str = "<f8") -> np.ndarray:
    values = list(values)
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1).astype(np.float64, copy=False)


class Blocks:
    """Rotated vectors as stored, a column of bytes for each block of COLUMNS dimensions; a block is decoded when it is read."""

    def __init__(self, columns: list):
        self.columns, self.shape = columns, (len(columns[0]), 0)

    def block(self, k: int) -> np.ndarray:
        return _matrix(self.columns[k], "<f4")


@dataclass
class Index:
    """rotation: (D, D) orthogonal, D the dimension plus one; lists: rotated centroids; radius2: the largest squared length."""

    rotation: np.ndarray
    lists: np.ndarray
    sample: np.ndarray
    sample_list: np.ndarray
    radius2: float
    probes: int

    def points(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(0, self.radius2 - np.einsum("ij,ij->i", x, x)))
        return np.c_[x, extra] @ self.rotation

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.c_[q, np.zeros(len(q))] @ self.rotation

    def nearest(self, p: np.ndarray, n: int) -> np.ndarray:
        own, out = (self.lists * self.lists).sum(1), []
        for a in range(0, len(p), 1024):
            d = own - 2 * (p[a : a + 1024] @ self.lists.T)
            out.append(d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n])
        return np.concatenate(out)

    def bound(self, p: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
        """Squared distance of the k-th nearest sampled vector in the probed lists: infinite if there are fewer."""
        if len(self.sample) < k:
            return np.full(len(p), np.inf)
        d = (p * p).sum(1)[:, None] + (self.sample * self.sample).sum(1) - 2 * (p @ self.sample.T)
        probed = np.zeros((len(p), len(self.lists)), bool)
        np.put_along_axis(probed, lists, True, axis=1)
        d[~probed[:, self.sample_list]] = np.inf
        return np.maximum(0, np.partition(d, k - 1, axis=1)[:, k - 1])


def fit(sample: np.ndarray, rows: int, radius2: float, k: int = K, seed: int = SEED) -> Index:
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    index = Index(rotation, np.zeros((1, dim)), np.zeros((0, dim)), np.zeros(0, int), radius2, 1)
    x = index.points(sample)
    n = max(1, min(MOST_LISTS, int(2 * rows**0.5), len(x)))
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(8):
        index.lists = centres
        own = index.nearest(x, 1)[:, 0]
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    index.lists, index.sample = centres, x
    index.sample_list = own = index.nearest(x, 1)[:, 0]
    some = rng.choice(len(x), min(CALIBRATION_QUERIES, len(x)), replace=False)
    q = index.queries(sample[some])
    score = sample[some] @ sample.T
    score[np.arange(len(some)), some] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(index.nearest(q, n), axis=1)  # the place of each list in each query's order
    found = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    index.probes = int(found[min(len(found) - 1, int(np.ceil(CALIBRATED_RECALL * len(found))))]) + 1 if len(found) else n
    return index


def scan_list(points: np.ndarray | Blocks, queries: np.ndarray, bound: np.ndarray, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs that no test abandons. Blocks of columns are dense until a tenth of the pairs is left.

    slack: what rounding of the points may add to a squared distance.
    """
    dim = queries.shape[1]
    partial = np.zeros((len(queries), points.shape[0]))
    i = j = None
    for k, a in enumerate(range(0, dim, COLUMNS)):
        b = min(dim, a + COLUMNS)
        margin = bound * (b / dim) * ((1 + EPSILON / b**0.5) ** 2 if b < dim else 1) + slack
        if i is not None and not len(i):
            break
        p = points.block(k) if isinstance(points, Blocks) else points[:, a:b]
        if i is None:
            q = queries[:, a:b]
            partial += (q * q).sum(1)[:, None] + (p * p).sum(1) - 2 * (q @ p.T)
            alive = partial <= margin[:, None]
            if b == dim or np.count_nonzero(alive) * 10 <= alive.size:
                i, j = np.nonzero(alive)
                left = partial[i, j]
        else:
            d = p[j] - queries[i, a:b]
            left = left + np.einsum("ij,ij->i", d, d)
            keep = left <= margin[i]
            i, j, left = i[keep], j[keep], left[keep]
    return i, j


def _top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product found for each query, its own id left out.

    vectors: vec_id, embedding; queries: vec_id, embedding, any rows of the same kind. Vectors that are null, zero or hold
    null or non-finite components, rows without id, and vectors of another length than the sample's first take no part.
    Rows repeated in full count once. Of equal vectors only the k + 1 smallest ids can be among the nearest, so no more
    are searched; equal queries are searched once. Fewer candidates than k: all of them. Empty in, empty out.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, vec binary, norm2 double"
    single = all(t.schema["embedding"].dataType == T.ArrayType(T.FloatType()) for t in (vectors, queries))
    dtype = "<f4" if single else "<f8"
    usable = staged(vectors.select("vec_id", "embedding").mapInArrow(_prepared(dtype), schema), "ann-vectors")
    rows, radius2 = usable.agg(F.count(F.lit(1)), F.max("norm2")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not rows:
        return empty
    order, some = F.xxhash64(F.lit(seed), "vec_id"), usable
    if rows > 2 * SAMPLE:  # a threshold leaves a little more than the sample, so the driver never sorts more than that
        some = usable.where(F.pmod(order, F.lit(1 << 30)) < int((1.2 * SAMPLE + 100) / rows * (1 << 30)) + 1)
    sample = some.orderBy(order, "vec_id").limit(SAMPLE).collect()
    width = len(sample[0]["vec"])
    index = fit(_matrix((r["vec"] for r in sample if len(r["vec"]) == width), dtype), rows, radius2, k, seed)
    usable = usable.where(F.octet_length("vec") == width)
    sent = spark.sparkContext.broadcast(index)  # at most SAMPLE + MOST_LISTS vectors
    slack = 1e-9 + 1e-6 * radius2  # blocks are stored in single precision
    columns = [f"block{n}" for n in range(-(-len(index.rotation) // COLUMNS))]

    def assigned(batches):
        own = sent.value
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                p = own.points(_matrix(part.column("vec").to_pylist(), dtype))
                at = own.nearest(p, 1)[:, 0]
                blocks = [pa.array([x.tobytes() for x in p[:, n * COLUMNS : (n + 1) * COLUMNS].astype("<f4")], pa.binary()) for n in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "vec")), pa.array(at, pa.int64()), *blocks], names=["vec_id", "vec", "list", *columns])

    def probing(batches):
        own = sent.value
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                p = own.queries(_matrix(part.column("vec").to_pylist(), dtype))
                lists = own.nearest(p, own.probes)
                yield pa.RecordBatch.from_arrays([*part.select(["query", "vec"]).columns, pa.array(own.bound(p, lists, k + 1)), pa.array(lists.tolist(), pa.list_(pa.int64()))], names=["query", "vec", "bound", "lists"])

    alike = Window.partitionBy("vec").orderBy("vec_id")
    distinct = usable.select("vec_id", "vec").distinct().withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).drop("n")
    stored = staged(distinct.mapInArrow(assigned, ", ".join(["vec_id long, vec binary, list long", *(f"{c} binary" for c in columns)])), "ann-lists")
    chunks = stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))  # at most MOST_LISTS rows

    asked = queries.select("vec_id", "embedding").mapInArrow(_prepared(dtype), schema).where(F.octet_length("vec") == width).select("vec_id", "vec").distinct()
    asked = staged(asked, "ann-queries")
    unique = asked.groupBy("vec").agg(F.min("vec_id").alias("query"))
    probed = staged(unique.select("query", "vec").mapInArrow(probing, "query long, vec binary, bound double, lists array<long>"), "ann-probes")

    def searched(key, queries_, vectors_):
        own, out = sent.value, []
        if len(queries_) and len(vectors_):
            x = _matrix(vectors_["vec"], dtype)
            points, ids = Blocks([vectors_[c] for c in columns]), vectors_["vec_id"].to_numpy()
            for a in range(0, len(queries_), 256):
                part = queries_.iloc[a : a + 256]
                q = _matrix(part["vec"], dtype)
                i, j = scan_list(points, own.queries(q), part["bound"].to_numpy(), slack)
                score = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
                asker = part["query"].to_numpy()[i]
                best = _top(asker, ids[j], score, k + 1)
                out.append(pd.DataFrame({"query": asker[best], "vec_id": ids[j][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, int), "vec_id": np.zeros(0, int), "score": np.zeros(0)})

    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def best_of(probed: DataFrame) -> DataFrame:
        visits = probed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).alias("parts"))
        dealing = F.broadcast(chunks.join(visits, "list"))  # a row a list
        tasks = probed.select("query", "vec", "bound", F.explode("lists").alias("list")).join(dealing, "list")
        tasks = tasks.withColumn("part", F.pmod(F.xxhash64("query"), "parts")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks", "parts")
        points = stored.join(dealing, "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("chunks", "parts")
        hits = tasks.groupBy("list", "chunk", "part").cogroup(points.groupBy("list", "chunk", "part")).applyInPandas(searched, "query long, vec_id long, score double")
        return hits.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n")

    best = staged(best_of(probed), "ann-best")
    have = best.groupBy("query").agg(F.count(F.lit(1)).alias("have"))
    few = unique.join(have, "query", "left").where(F.coalesce("have", F.lit(0)) < min(k + 1, stored.count())).select("query", "vec")
    few = staged(few, "ann-few")
    if not few.isEmpty():
        everywhere = few.select("query", "vec", F.lit(float("inf")).alias("bound"), F.sequence(F.lit(0).cast("long"), F.lit(len(index.lists) - 1).cast("long")).alias("lists"))
        best = best.join(few, "query", "left_anti").unionByName(best_of(everywhere))
    askers = asked.join(unique, "vec").select(F.col("vec_id").alias("query_id"), "query")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = askers.join(best, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
