"""Exact top-k search (operator 5): columnar branch-and-bound over integer vectors.

Candidates stay where they are read. Queries are counted and dealt to blocks of QUERY_BYTES; blocks are read one after
another, so that the driver and each task hold one, and with more than one block each block's result is written before
the next is read. A task holds a batch of candidates in vertical layout, one row a dimension, and for each query adds
the products dimension block by dimension block, the dimensions of the largest query mass first. After a block, what is
left of a score is at most the product of the norms of the remaining dimensions; candidates whose bound is below the
k-th best score so far are dropped and the survivors compacted. The k-th best of a task carries over from batch to
batch. It begins at the query's k-th best score among one candidate in FIRST, searched before: a task then returns only
what reaches that score, some k * FIRST rows a query over all tasks however many those are. A window keeps the best k.

Scores are exact: products and sums stay below 2^53 in float64, or else int64 is used. Bounds are rounded up.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a
null id; shorter vectors count as padded with zeros; ties go to the smaller id; rows with a query's own id are not
its candidates; repeated candidate rows are candidates each; a repeated query id counts once (its first vector in
order); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut, importable, stored

K, EVERY, SCALE = 10, 100, 1024
DIMENSIONS = 16  # a block of dimensions
QUERY_BYTES = 16 << 20
BATCH = 8192
#: Queries whose first products with a batch are held at once.
QUERIES = 256
#: One candidate in so many is searched first.
FIRST = 64


def integer_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, v (array<long>) of the rows (vec_id, embedding) that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col("vec_id").cast("long").alias("id"), v.alias("x"), ok.alias("ok")).filter("ok").select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """(n, width) int64 of a list array, padded with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


class Search:
    """The best k candidates of each query of a block, over batches of candidates."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        """floor: a score that k candidates of each query are known to reach."""
        self.ids, self.queries, self.k = ids, queries, k
        self.floor = np.full(len(ids), np.iinfo(np.int64).min) if floor is None else floor
        self.best_score: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        self.best_id: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        mass = (queries.astype(np.float64) ** 2).sum(axis=0)
        self.order = np.argsort(-mass, kind="stable")
        self.q = queries[:, self.order]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(vectors.shape[1], self.q.shape[1])
        if width > self.q.shape[1]:
            grown = width - self.q.shape[1]
            self.q = np.pad(self.q, ((0, 0), (0, grown)))
            self.order = np.concatenate((self.order, np.arange(len(self.order), width)))
        if vectors.shape[1] < width:
            vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        most = float(np.abs(self.q).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * width
        kind = np.float64 if most < 2**53 else np.int64
        columns = np.ascontiguousarray(vectors[:, self.order].T).astype(kind)  # one row a dimension
        q = self.q.astype(kind)
        cuts = list(range(0, width, DIMENSIONS)) + [width]
        # Remaining norms after each block; a little is added so that rounding never makes a bound too small.
        rest = [(np.sqrt((columns[c:].astype(np.float64) ** 2).sum(axis=0)) * (1 + 1e-9), np.sqrt((q[:, c:].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)) for c in cuts[1:]]
        for i in range(len(self.ids)):
            if i % QUERIES == 0:
                first = q[i : i + QUERIES, : cuts[1]] @ columns[: cuts[1]]  # every query needs the first block of every candidate
            alive = np.flatnonzero(ids != self.ids[i])
            score = first[i % QUERIES, alive]
            for b in range(len(cuts) - 1):
                if b:
                    score = score + q[i, cuts[b] : cuts[b + 1]] @ columns[cuts[b] : cuts[b + 1], alive]
                if cuts[b + 1] == width:
                    break
                spread = rest[b][0][alive] * rest[b][1][i] + 1
                bar = self._bar(i, score - spread)
                keep = score + spread >= bar
                if not keep.all():
                    alive, score = alive[keep], score[keep]  # compact the survivors
            self._keep(i, ids[alive], score.astype(np.int64))

    def _bar(self, i: int, least: np.ndarray) -> float:
        """The k-th best of what is sure: scores kept so far, or lower bounds of this batch."""
        own = self.best_score[i]
        bar = float(self.floor[i])
        if len(own) == self.k:
            bar = max(bar, float(own[-1]))
        if len(least) >= self.k:
            bar = max(bar, float(np.partition(least, len(least) - self.k)[len(least) - self.k]))
        return bar

    def _keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        reach = scores >= self.floor[i]
        if not reach.all():
            ids, scores = ids[reach], scores[reach]
        if not len(ids):
            return
        ids, scores = np.concatenate((self.best_id[i], ids)), np.concatenate((self.best_score[i], scores))
        order = np.lexsort((ids, -scores))[: self.k]
        self.best_id[i], self.best_score[i] = ids[order], scores[order]

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.best_id]
        none = [np.empty(0, np.int64)]
        cols = [np.repeat(self.ids, n), np.concatenate(self.best_id or none), np.concatenate(self.best_score or none)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])


def _best(candidates: DataFrame, shared, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of a block of queries."""

    def run(batches):
        search = Search(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                own = b.slice(at, BATCH)
                vectors = own.column(1)
                longest = int(np.diff(vectors.offsets.to_numpy()).max(initial=0))
                search.add(own.column(0).to_numpy(), matrix(vectors, max(longest, 1)))
        yield search.rows()

    found = candidates.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score; both sides are (id, v) as of integer_vectors."""
    spark = candidates.sparkSession
    importable(spark)
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n, width = queries.agg(F.count("*"), F.max(F.size("v"))).collect()[0]
    if not n:
        return candidates.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    parts = -(-n * width * 8 // query_bytes)
    if parts > 1:
        queries = cut(queries)
    results = []
    for part in range(parts):
        own = (queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(parts)) == part)).toArrow().combine_chunks()  # about query_bytes
        if not own.num_rows:
            continue
        ids, block = own["id"].to_numpy(), matrix(own["v"].chunk(0), width)
        early = spark.sparkContext.broadcast((ids, block, k))
        ahead = _best(candidates.filter(F.pmod(F.xxhash64("id", F.lit("first")), F.lit(first)) == 0), early, k)
        bars = ahead.filter(F.col("rank") == k).select("query_id", "score").toArrow()  # a row a query of the block
        at = dict(zip(bars["query_id"].to_pylist(), bars["score"].to_pylist(), strict=True))
        early.destroy()
        least = np.iinfo(np.int64).min
        shared = spark.sparkContext.broadcast((ids, block, k, np.array([at.get(i, least) for i in ids.tolist()], np.int64)))
        result = _best(candidates, shared, k)
        if parts == 1:
            return result
        results.append(stored(result))
        shared.destroy()
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.pmod("id", F.lit(EVERY)) == 0))


ORACLE = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= {K}"""
