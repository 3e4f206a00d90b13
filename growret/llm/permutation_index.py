"""Operator 4, approximate nearest neighbours with a permutation index.

``PIVOTS`` vectors, a bounded sample, are the pivots.  A vector is represented
by the order of its ``PREFIX`` nearest pivots, and posted in the inverted file
of each of them with the pivot's rank.  A query reads the files of its own
nearest pivots and ranks the vectors by the induced footrule distance: a pivot
both have adds the difference of its ranks, one that only one of them has adds
``PREFIX`` less its rank there.  Of each index block the best ``CANDIDATES``
share of its vectors, and 12 times the wanted neighbours at least, is reranked
by the inner product of the original vectors in double precision.

The index is dealt by hash into blocks of about ``BLOCK`` vectors, each with
its own inverted files, and the queries into blocks of ``QUERIES``.  A task
holds one cell of both, so equal vectors, however many, fill blocks evenly;
every row is indexed.  A cell sends the ``k`` best of each query; they are
merged per query.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component takes no part, neither does a row without vec_id, nor one
whose length differs from that of the pivots; equal scores rank by vec_id; a
query never finds rows with its own vec_id; of repeated rows with the same id
and vector one is kept; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIVOTS = 128
PREFIX = 64
CANDIDATES = 0.2
ALIKE = 0.7
BLOCK = 4096
QUERIES = 1024
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def choose_pivots(rows: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """n pivots of length 1, from the 8 * n rows with the smallest hashes of vec_id.

    In that order a vector is passed over if its cosine with a pivot is ``ALIKE``
    or more; what is passed over fills up if there are too few others.  Else a
    crowd of like vectors would hold many pivots, whose order says nothing.
    """
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(8 * n).collect()
    if not drawn:
        return np.zeros((0, 0))
    size = len(drawn[0]["v"])
    points = np.array(list(dict.fromkeys(tuple(r["v"]) for r in drawn if len(r["v"]) == size)))
    points /= np.abs(points).max(axis=1, keepdims=True)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    chosen: list[int] = []
    for k in range(len(points)):
        if not chosen or (points[chosen] @ points[k]).max() < ALIKE:
            chosen.append(k)
    spare = [k for k in range(len(points)) if k not in set(chosen)]
    return points[(chosen + spare)[:n]]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots by cosine, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    """Per pivot the ranks it has in a block's vectors, ``prefix`` in those it is not among the nearest of."""

    def __init__(self, orders: np.ndarray, n_pivots: int) -> None:
        n, self.prefix = orders.shape
        #: the narrowest types that hold a rank and a distance: twice the bytes take twice the time
        self.sum_type = np.int16 if self.prefix * (self.prefix + 1) <= np.iinfo(np.int16).max else np.int32
        self.files = np.full((n_pivots, n), self.prefix, np.int8 if self.prefix <= np.iinfo(np.int8).max else np.int32)
        self.files[orders, np.arange(n)[:, None]] = np.arange(self.prefix)
        self.rank = np.arange(self.prefix, dtype=self.files.dtype)[:, None]

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of one query to every vector of the block.

        A pivot adds |r - s| for the ranks r and s; less the prefix - r and
        prefix - s that both sides pay for one that is not shared, that is
        2 * (max(r, s) - prefix), and 0 where s = prefix.
        """
        larger = np.maximum(self.files[order], self.rank).sum(axis=0, dtype=self.sum_type)
        return self.prefix * (self.prefix + 1) + 2 * (larger.astype(np.int32) - self.prefix * self.prefix)


def search(
    vectors: DataFrame,
    query_rows: DataFrame,
    k: int = 20,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    candidates: float = CANDIDATES,
    block: int = BLOCK,
    queries: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows found for each query row."""
    rows, asked = usable(vectors), usable(query_rows)
    points = choose_pivots(rows, pivots)
    if not len(points):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    prefix, width = min(prefix, len(points)), points.shape[1]
    rows, asked = rows.filter(F.size("v") == width), asked.filter(F.size("v") == width)
    blocks, groups = (max(1, -(-df.count() // n)) for df, n in ((rows, block), (asked, queries)))
    dealt = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    indexed = dealt(rows, blocks, "i").withColumn("j", every(groups))
    asking = dealt(asked, groups, "j").withColumn("i", every(blocks))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def cell(index: pa.Table, query: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(index) and len(query):
            v, ids = matrix(index["v"]), index["vec_id"].to_numpy()
            q, q_ids = matrix(query["v"]), query["vec_id"].to_numpy()
            scale = lambda x: x / np.abs(x).max(axis=1, keepdims=True)
            # equal vectors are indexed once; only the k + 1 smallest ids among them can be an answer
            _, same = np.unique(np.ascontiguousarray(v + 0.0).view(f"V{8 * width}"), return_inverse=True)
            order = np.lexsort((ids, same.reshape(-1)))
            v, ids, same = v[order], ids[order], same.reshape(-1)[order]
            begin = np.flatnonzero(np.diff(same, prepend=-1))
            copies = np.minimum(np.diff(np.append(begin, len(v))), k + 1)
            files = InvertedFiles(nearest_pivots(scale(v[begin]), points, prefix), len(points))
            n = min(len(begin), max(12 * k, int(np.ceil(candidates * len(begin)))))
            for own, nearest, vector in zip(q_ids, nearest_pivots(scale(q), points, prefix), q):
                near = np.argpartition(files.footrule(nearest), n - 1)[:n] if n < len(begin) else np.arange(len(begin))
                score = (v[begin[near]] * vector).sum(axis=1)
                each = copies[near]
                at = np.repeat(begin[near] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                score, at = np.repeat(score, each)[ids[at] != own], at[ids[at] != own]
                best = np.lexsort((ids[at], -score))[:k]
                out.append((np.full(len(best), own), ids[at][best], score[best]))
        q_id, v_id, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": pa.array(q_id, pa.int64()), "vec_id": pa.array(v_id, pa.int64()), "score": pa.array(score, pa.float64())})

    found = asking.groupBy("i", "j").cogroup(indexed.groupBy("i", "j"))
    met = found.applyInArrow(lambda query, index: cell(index, query), FOUND)
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
