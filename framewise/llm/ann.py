"""Approximate nearest neighbours by collision counting with query-centred windows.

A hash function is a single random projection.  The index of a block of vectors holds, for each of m projections, the
projected values in order and each vector's place in that order.  A query's bucket is the window around its own
projection: two binary searches, and a vector is in it if its place lies between them.  At radius R a vector within R lies in a
window of half width ``HALF * R`` with probability p = P(|z| <= HALF), so it collides in about p m projections; vectors
that collide in at least ``FEWEST`` of m are verified by their true distance.  Virtual rehashing widens all windows of
a query with R, up to its bound: the distance to the k-th nearest vector of a sample, within which the k nearest of all lie.
A block's search ends before that when k verified vectors lie within R.

The sample (at most ``SAMPLE`` vectors, the first in the order of a hash of their ids) also gives at most ``CELLS``
pivots.  All vectors go to the cell of their nearest pivot, large cells to several blocks, and a query meets
the blocks of those cells only that reach into its bound.  Every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

PROJECTIONS, HALF, FEWEST = 128, 1.6, 0.86
#: Factors of the bound at which windows are searched.
RADII = (0.4, 0.6, 0.8, 0.92, 1.0)
SAMPLE, CELLS, SEED = 4096, 256, 20240501
#: Vectors of a block: about BLOCK_VALUES components, and few enough for 16-bit places.
BLOCK_VALUES, LEAST_BLOCK, MOST_BLOCK = 1 << 19, 256, 1 << 15
OUT = "query_id long, query_key long, vec_id long, score double, verified long"


def usable(vec):
    """Not null or empty, no null, NaN or infinite component, not all zero."""
    big = F.lit(float("inf"))
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(vec, lambda x: x != 0), F.lit(False))


def distances(vecs: np.ndarray, q: np.ndarray) -> np.ndarray:
    diff = vecs - q
    return np.sqrt((diff * diff).sum(axis=1))


class Index:
    """Sorted projections of a block of vectors, and each vector's place in them."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vecs = ids, vecs
        self.lines = np.random.default_rng(SEED).standard_normal((vecs.shape[1], projections))
        at = (vecs @ self.lines).T
        self.order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, self.order, axis=1)
        self.place = np.empty(at.shape, np.uint16)
        np.put_along_axis(self.place, self.order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)

    def collisions(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In how many of the windows [lo, hi) each vector lies."""
        if int((hi - lo).sum()) * 16 < self.place.size:
            inside = [self.order[j, lo[j] : hi[j]] for j in np.flatnonzero(hi > lo)]
            return np.bincount(np.concatenate(inside), minlength=len(self.ids)) if inside else np.zeros(len(self.ids), np.int64)
        return ((self.place - lo[:, None].astype(np.uint16)) < (hi - lo)[:, None].astype(np.uint16)).view(np.uint8).sum(axis=0, dtype=np.uint16)

    def nearest(self, query_id: int, q: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, distances) of the k nearest verified vectors within ``bound`` (of all, if it is infinite); how many were verified."""
        n, m = self.place.shape[1], len(self.place)
        at, fewest = q @ self.lines, math.ceil(FEWEST * m)
        known, dist = np.zeros(n, bool), np.full(n, np.inf)
        own = self.ids == query_id
        want = min(k, n - int(own.sum()))
        for radius in self.radii(bound):
            if math.isinf(radius):
                fresh = np.flatnonzero(~known & ~own)
            else:
                half = HALF * radius * (1 + 1e-9) + 1e-300
                lo = np.fromiter((np.searchsorted(s, x - half) for s, x in zip(self.sorted, at, strict=True)), np.int64, m)
                hi = np.fromiter((np.searchsorted(s, x + half, "right") for s, x in zip(self.sorted, at, strict=True)), np.int64, m)
                if int((hi > lo).sum()) < fewest:
                    continue
                fresh = np.flatnonzero((self.collisions(lo, hi) >= fewest) & ~known & ~own)
            if len(fresh):
                known[fresh] = True
                dist[fresh] = distances(self.vecs[fresh], q)
            if (dist <= radius).sum() >= want:
                break
        near = np.flatnonzero(known)
        best = near[np.lexsort((self.ids[near], dist[near]))][:k]
        return self.ids[best], dist[best], len(near)

    def radii(self, bound: float) -> Iterator[float]:
        """Radii up to the bound; without one they double from the typical distance of a few vectors until everything is verified."""
        if not math.isinf(bound):
            yield from (bound * x for x in RADII)
            return
        some = self.vecs[np.linspace(0, len(self.vecs) - 1, min(len(self.vecs), 32)).astype(int)]
        radius = 0.25 * float(np.median(np.linalg.norm(some[:, None] - some[None], axis=2))) or 1e-9
        yield from (radius * 2**i for i in range(4))
        yield math.inf


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _search(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: list[tuple] = []
    if vectors.num_rows and queries.num_rows:
        index = Index(vectors.column("vec_id").to_numpy(), _matrix(vectors.column("vec").combine_chunks()))
        ids, keys, bounds = (queries.column(c).to_numpy() for c in ("query_id", "query_key", "bound"))
        for query_id, key, bound, q in zip(ids, keys, bounds, _matrix(queries.column("vec").combine_chunks()), strict=True):
            found, dist, verified = index.nearest(query_id, q, bound, k)
            n = len(found)
            out.append((np.full(n, query_id), np.full(n, key), found, dist, np.where(np.arange(n) == 0, verified, 0)))
    cols = [np.concatenate([x[i] for x in out]) if out else np.zeros(0) for i in range(5)]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.table({name.split()[0]: pa.array(c.astype(t.to_pandas_dtype())) for name, c, t in zip(OUT.split(", "), cols, types, strict=True)})


def _by_length(b: pa.RecordBatch, column: str = "vec") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, row numbers, matrix) of the rows of each length."""
    lists = b.column(b.schema.get_field_index(column))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, _matrix(lists.take(pa.array(at)))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows by the product of matrices: for choosing cells only."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


def _celled(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cell, reach = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
        for dim, at, vecs in _by_length(b):
            if dim in pivots:
                cell[at] = _far(vecs, pivots[dim]).argmin(axis=1)
                reach[at] = np.sqrt(((vecs - pivots[dim][cell[at]]) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(reach)], names=["vec_id", "vec", "dim", "cell", "reach"])


def _bounded(batches: Iterator[pa.RecordBatch], k: int, sample: dict, pivots: dict, cells: dict) -> Iterator[pa.RecordBatch]:
    """Each query with its bound, what of the sample is nearest, and the blocks it has to meet."""
    names = ["query_id", "query_key", "vec", "dim", "bound", "near", "blocks"]
    near_type, block_type = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])), pa.list_(pa.struct([("cell", pa.int32()), ("part", pa.int32())]))
    for b in batches:
        bound, near, blocks = [math.inf] * b.num_rows, [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
        ids = b.column(0).to_numpy()
        for dim, at, vecs in _by_length(b):
            known = cells.get(dim, {})
            for i, q in zip(at.tolist(), vecs, strict=True):
                if dim in sample:
                    sample_ids, some = sample[dim]
                    dist = distances(some, q)
                    best = np.lexsort((sample_ids, dist))
                    best = best[sample_ids[best] != ids[i]][:k]
                    near[i] = [{"vec_id": int(sample_ids[j]), "score": float(dist[j])} for j in best]
                    if len(best) == k:
                        bound[i] = float(dist[best[-1]])
                far = distances(pivots[dim], q) if dim in pivots else np.zeros(1)
                blocks[i] = [{"cell": c, "part": p} for c, (parts, reach) in known.items() if far[c] - reach <= bound[i] * (1 + 1e-9) for p in range(parts)]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(bound, pa.float64()), pa.array(near, near_type), pa.array(blocks, block_type)], names=names)


def _sampled(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (ids, vectors)} of at most SAMPLE vectors, the same whenever it runs."""
    out = {}
    for b in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vec")).limit(SAMPLE).select("vec_id", "vec").toArrow().combine_chunks().to_batches():
        for dim, at, vecs in _by_length(b):
            out[dim] = (b.column(0).to_numpy()[at], vecs)
    return out


def searched(vectors: DataFrame, queries: DataFrame, k: int = 10, block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, query_key, vec_id, score, verified: what blocks and sample give each query; ``verified`` adds up to how many vectors blocks verified for it."""
    slim = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").alias("vec"), F.size("embedding").alias("dim")).dropDuplicates(["vec_id", "vec"])
    #: Of equal vectors the k + 1 smallest ids are all that can be among anyone's nearest.
    alike = W.partitionBy(F.xxhash64("vec"), F.xxhash64(F.lit("vec"), F.col("vec")), "dim").orderBy("vec_id")
    vectors = stored(slim(vectors).withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1).select("vec_id", "vec", "dim"), "vectors")
    queries = slim(queries).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("query_key"), "vec", "dim")
    most = lambda dim: min(MOST_BLOCK, max(LEAST_BLOCK, block_values // dim))
    sample = _sampled(vectors)
    counts = {r["dim"]: r["count"] for r in vectors.where(F.col("dim").isin(list(sample))).groupBy("dim").count().collect()} if sample else {}
    pivots = {dim: vecs[: min(CELLS, math.ceil(counts[dim] / most(dim)))] for dim, (_, vecs) in sample.items()}
    kind = vectors.schema["vec"].dataType.simpleString()
    celled = stored(vectors.mapInArrow(lambda it: _celled(it, pivots), f"vec_id long, vec {kind}, dim int, cell int, reach double"), "celled")
    #: Lengths that the sample doesn't hold have one cell each, without a bound.
    sizes = celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach"))
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("n") / F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.floor(F.lit(block_values) / F.col("dim"))))).cast("int")), "cells")
    cells: dict[int, dict[int, tuple[int, float]]] = {}
    for r in sizes.where(F.col("dim").isin(list(sample))).collect() if sample else []:
        cells.setdefault(r["dim"], {})[r["cell"]] = (r["parts"], r["reach"])
    near = "array<struct<vec_id:bigint,score:double>>"
    bounded = queries.mapInArrow(lambda it: _bounded(it, k, sample, pivots, cells), f"query_id long, query_key long, vec {kind}, dim int, bound double, near {near}, blocks array<struct<cell:int,part:int>>")
    bounded = stored(bounded, "bounded")
    query_parts = max(1, math.ceil(bounded.count() * (max(sample) if sample else 1) / (4 * block_values)))
    met = bounded.select("query_id", "query_key", "vec", "dim", "bound", F.explode("blocks").alias("b")).select("query_id", "query_key", "vec", "dim", "bound", "b.cell", "b.part")
    rare = bounded.where(~F.col("dim").isin(list(sample))).drop("near", "blocks").join(sizes.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "dim")
    met = met.unionByName(rare.select(met.columns)).withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int"))
    blocks = celled.join(sizes.select("dim", "cell", "parts"), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    blocks = blocks.select("dim", "cell", "part", "vec_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("query_part"))
    keys = ["dim", "cell", "part", "query_part"]
    found = blocks.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(lambda v, q: _search(v, q, k), OUT)
    own = bounded.select("query_id", "query_key", F.explode("near").alias("n")).select("query_id", "query_key", "n.vec_id", "n.score", F.lit(0).cast("long").alias("verified"))
    return found.unionAll(own)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` (vec_id, embedding) its k nearest found of ``vectors``.

    Score is the Euclidean distance in double precision; ties go to the smaller vec_id.  Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do rows without an id.  A query is never its own neighbour
    (by vec_id), rows that repeat id and vector count once, queries of one id and different vectors are ranked apart, and only vectors of
    one length are compared.  Other columns aren't read; empty tables give an empty one.
    """
    found = searched(vectors, queries, k, block_values).dropDuplicates(["query_id", "query_key", "vec_id", "score"])
    rank = F.row_number().over(W.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
