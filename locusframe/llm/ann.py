"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking.

Unit vectors are hashed by K Gaussian projections, shifted, divided by the width and floored, in each of L tables.
A query visits its own bucket and those reached by steps of -1, 0 or 1 in each projection, in the order of the
sum of squared distances to the crossed boundaries, the estimate of how likely a neighbour lies there.  Buckets are
dealt to groups of bounded size; a bucket above that bound is split by a hash of the vector's id and its queries go
to all parts.  Each group reranks the vectors of the buckets that a query visits by exact cosine and returns the
query's k nearest, so what is shuffled after it does not depend on how full a bucket is.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.scratch import Scratch
from locusframe.llm.wordhash import U, mix

#: Vectors of one group (a split bucket's part included), and split buckets that the plan may name in a broadcast.
GROUP_VECTORS, MAX_SPLIT = 16_384, 50_000


class Hasher:
    """L tables of K projections, and the probes of a query."""

    def __init__(self, dim: int, tables: int, projections: int, width: float, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim, projections))
        self.b = rng.uniform(0, width, size=(tables, projections))
        self.width = width
        self.steps = np.array(list(itertools.product((0, -1, 1), repeat=projections)), dtype=np.int64)
        self.probes = min(probes, len(self.steps))
        self.salt = mix(np.arange(1, projections + 1, dtype=U) * U(0x9E3779B97F4A7C15))

    def places(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.a[table] + self.b[table]) / self.width

    def bucket(self, cell: np.ndarray) -> np.ndarray:
        """A 64-bit number of each cell (last axis: projections)."""
        return mix(((cell.astype(np.int64).view(U) + U(1 << 32)) * (self.salt | U(1))).sum(axis=-1, dtype=U)).view(np.int64)

    def visited(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Buckets of the probes of each vector, most promising first."""
        at = self.places(unit, table)
        cell = np.floor(at).astype(np.int64)
        below = at - cell
        cost = below**2 @ (self.steps == -1).T.astype(float) + (1 - below) ** 2 @ (self.steps == 1).T.astype(float)
        best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
        return self.bucket(cell[:, None, :] + self.steps[best])


def _unit(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    norm = np.sqrt((x * x).sum(axis=1))
    return x, norm


def _vectors(dim: int):
    """(id, raw doubles) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is not None and v is not None and len(v) == dim and None not in v:
                    x = np.array(v, dtype="<f8")
                    top = np.abs(x).max(initial=0.0)
                    if np.isfinite(top) and top > 0:
                        if not 1e-100 < top < 1e100:  # its square would leave the range of doubles; a power of two changes no cosine
                            x = np.ldexp(x, -np.frexp(top)[1])
                        ids.append(i)
                        raws.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], ["id", "raw"])

    return run


def _deal(hasher: Hasher, groups: int, split: dict[tuple[int, int], int], queries: bool):
    """Rows for every table: (tab, gid, id, raw, buckets); an index row has one bucket and one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                ids, raws = part.column(0).to_pylist(), part.column(1).to_pylist()
                x, norm = _unit(raws)
                out: dict[str, list] = {"tab": [], "gid": [], "id": [], "raw": [], "buckets": []}
                for t in range(len(hasher.a)):
                    unit = x / norm[:, None]
                    found = hasher.visited(unit, t) if queries else hasher.bucket(np.floor(hasher.places(unit, t)))[:, None]
                    for i, raw, own in zip(ids, raws, found):
                        mine: dict[int, list[int]] = {}
                        for b in own.tolist():
                            parts = split.get((t, b))
                            if parts is None:
                                mine.setdefault(b % groups, []).append(b)
                            else:
                                pick = range(parts) if queries else [int(mix(np.array([i], dtype=np.int64).view(U))[0]) % parts]
                                for p in pick:
                                    mine.setdefault(-1 - (((b & 0xFFFFFFFFFFF) << 18) | p), []).append(b)
                        for g, bs in mine.items():
                            for key, v in zip(out, (t, g, i, raw, bs)):
                                out[key].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["tab"], pa.int32()), pa.array(out["gid"], pa.int64()), pa.array(out["id"], pa.int64()), pa.array(out["raw"], pa.binary()), pa.array(out["buckets"], pa.list_(pa.int64()))], list(out))

    return run


def nearest(q: np.ndarray, q_norm: float, q_id: int, x: np.ndarray, norm: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the k nearest other ids, each with its nearest row; ties go to the smaller id. The sum of each pair runs in one
    fixed order, so equal vectors get equal scores wherever they are compared."""
    score = (x @ q) / (norm * q_norm)
    score[ids == q_id] = -np.inf
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge - 1e-9)
        if len(np.unique(ids[near])) < k:  # rows of one id take up the places: the edge goes by ids
            each, own = np.unique(ids, return_inverse=True)
            best = np.full(len(each), -np.inf)
            np.maximum.at(best, own, score)
            near = np.flatnonzero(score >= np.partition(best, max(len(best) - k, 0))[max(len(best) - k, 0)] - 1e-9)
        x, norm, ids, score = x[near], norm[near], ids[near], score[near]
    exact = (x * q).sum(axis=1) / (norm * q_norm)
    exact[ids == q_id] = -np.inf
    order = np.lexsort((ids, -exact))
    order = order[np.isfinite(exact[order])]
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
    return ids[order], exact[order]


def _rerank(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(index) or not len(queries):
            return none
        bucket = np.array([b[0] for b in index["buckets"]], dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        x, norm = _unit(list(index["raw"]))
        x, norm, ids = x[order], norm[order], index["id"].to_numpy()[order]
        q, q_norm = _unit(list(queries["raw"]))
        out_q, out_v, out_s = [], [], []
        for i, (q_id, visited) in enumerate(zip(queries["id"].to_numpy(), queries["buckets"])):
            visited = np.asarray(visited, dtype=np.int64)
            lo, hi = np.searchsorted(bucket, visited, "left"), np.searchsorted(bucket, visited, "right")
            has = hi > lo
            if not has.any():
                continue
            lo, size = lo[has], (hi - lo)[has]
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            v, s = nearest(q[i], q_norm[i], q_id, x[rows], norm[rows], ids[rows], k)
            out_q += [q_id] * len(v)
            out_v += v.tolist()
            out_s += s.tolist()
        return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_s}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tables: int = 4, projections: int = 8, width: float = 2.0, probes: int = 700, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found, by cosine, for each row where is_query holds.

    is_query is a column of vectors, as ``F.col("vec_id") % 50 == 0``; candidates are all rows of another id.
    Ties go to the smaller id.  A query for which the buckets yield fewer than k rows is compared with all rows,
    block by block, so it gets k if there are so many.  Vectors that are null, zero, hold null or non-finite
    components, have no id, or another length than most have, take no part; an id that repeats counts once in a
    result, with its nearest vector; equal rows are equal candidates.  Vectors of any length of one table are read whole,
    and what the other columns are called plays no part.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    source = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = source.where("id is not null and v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    schema = "query_id bigint, vec_id bigint, score double"
    if not sizes or not sizes[0]["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    hasher = Hasher(sizes[0]["n"], tables, projections, width, probes, seed)
    dim = sizes[0]["n"]
    index = scratch.cut(source.select("id", "v").mapInArrow(_vectors(dim), "id bigint, raw binary"), "vectors")
    asked = scratch.cut(source.where("q").select("id", "v").mapInArrow(_vectors(dim), "id bigint, raw binary"), "queries")
    n = index.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    groups = max(1, -(-n // GROUP_VECTORS))
    dealt = "tab int, gid bigint, id bigint, raw binary, buckets array<bigint>"
    full = index.mapInArrow(_deal(hasher, groups, {}, False), dealt).groupBy("tab", F.col("buckets")[0].alias("b")).count()
    most = max(GROUP_VECTORS // 2, n * tables // MAX_SPLIT)  # no more than MAX_SPLIT buckets can be larger
    split = {(r["tab"], r["b"]): -(-r["count"] // most) for r in full.where(F.col("count") > most).collect()}
    a = index.mapInArrow(_deal(hasher, groups, split, False), dealt)
    b = asked.mapInArrow(_deal(hasher, groups, split, True), dealt)
    found = a.groupBy("tab", "gid").cogroup(b.groupBy("tab", "gid")).applyInPandas(_rerank(k), schema)
    found = scratch.cut(found, "found")

    got = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("c"))
    short = asked.join(got.where(F.col("c") >= min(k, n - 1)), asked["id"] == got["query_id"], "left_anti")
    if not short.limit(1).isEmpty():
        parts = max(1, -(-n // GROUP_VECTORS))
        one = F.array(F.lit(0).cast("bigint")).alias("buckets")
        a = index.select(F.lit(0).alias("tab"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("bigint").alias("gid"), "id", "raw", one)
        b = short.select(F.lit(0).alias("tab"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("gid"), "id", "raw", one)
        found = found.unionByName(a.groupBy("tab", "gid").cogroup(b.groupBy("tab", "gid")).applyInPandas(_rerank(k), schema))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
