"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of a fixed size. For a block, every candidate is scored
three times, by matrix products on the executors, and nothing but counts and winners
leaves a task:

1. a histogram of each query's scores over its whole range locates the bin of its kth score;
2. the same within that bin, again and again, until the bin is one score wide;
3. rows above the kth score are kept, ties at it go to the smaller ids.

A task's own kth score bounds the global one from below, so a task sends only its bins
down to the one that holds its own kth score: at most k bins a query, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, stored

#: Rows of candidates that are scored at once, for a bounded score matrix.
STEP = 512


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): components as floor(scale * x) of doubles; rows with a null id, and
    vectors null or with null or non-finite components, are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` integers; missing components are 0."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = at < width  # a query has no component there, so the product has none
    out[rows[inside], at[inside]] = flat[inside]
    return out


@dataclass
class _Block:
    """One block of queries: ids and integer components, and k."""

    ids: np.ndarray
    q: np.ndarray
    k: int

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(candidate ids, integer scores [candidate, query], own) in small steps."""
        width = self.q.shape[1]
        top_q = int(np.abs(self.q).max(initial=0))
        exact = self.q.astype(np.float64)
        for batch in batches:
            c = _matrix(batch.column(1), width)
            ids = batch.column(0).to_numpy()
            # Products of doubles are exact as long as no partial sum can reach 2 ** 53.
            as_double = float(top_q) * float(np.abs(c).max(initial=0)) * width < 2.0**53
            for i in range(0, len(c), STEP):
                part = c[i : i + STEP]
                s = (part.astype(np.float64) @ exact.T).astype(np.int64) if as_double else part @ self.q.T
                yield ids[i : i + STEP], s, ids[i : i + STEP, None] == self.ids[None, :]


def _histogram(block: _Block, low: np.ndarray, width: np.ndarray, bins: int):
    """Counts of the block's scores in ``bins`` bins from ``low``; what lies above falls in one last bin."""

    def run(batches):
        n = len(block.ids)
        counts = np.zeros((n, bins + 1), np.int64)
        base = np.arange(n) * (bins + 1)
        for _, s, own in block.scores(batches):
            at = np.minimum((s - low[None, :]) // width[None, :], bins)
            keep = (at >= 0) & ~own
            counts += np.bincount((at + base[None, :])[keep], minlength=n * (bins + 1)).reshape(n, bins + 1)
        # From the top, bins before which fewer than k rows were met.
        above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < block.k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return run


def _winners(block: _Block, kth: np.ndarray):
    """Rows at or above the kth score, at most k a query and task, ties to the smaller ids."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def cut(final: bool = False):
            nonlocal held, size
            if not held or (not final and size < 1 << 20):
                return
            q, v, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            keep = rank < block.k
            held, size = [(q[keep], v[keep], s[keep])], 0

        for ids, s, own in block.scores(batches):
            c, q = np.nonzero((s >= kth[None, :]) & ~own)
            held.append((q, ids[c], s[c, q]))
            size += len(c)
            cut()
        cut(final=True)
        for q, v, s in held:
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def _search_block(candidates: DataFrame, block: _Block, reach: np.ndarray, bins: int) -> DataFrame:
    """``reach``: no score of a query is further from 0 than this."""
    low, width = -reach, np.maximum((2 * reach) // bins + 1, 1)
    while True:
        counts = candidates.mapInArrow(_histogram(block, low, width, bins), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        # One row a query of the block: the bin that holds its kth score, or its lowest bin if it has fewer rows.
        found = counts.withColumn("upto", above).groupBy("q").agg(F.coalesce(F.max(F.when(F.col("upto") >= block.k, F.col("bin"))), F.min("bin")).alias("bin"), F.max("upto").alias("all"))
        got = found.toPandas()
        at = np.zeros(len(low), np.int64)
        at[got.q.to_numpy()] = got.bin.to_numpy()
        short = np.ones(len(low), bool)
        short[got.q.to_numpy()] = got["all"].to_numpy() < block.k
        if (width == 1).all():
            kth = np.where(short, low, low + at)
            return candidates.mapInArrow(_winners(block, kth), "query_id long, vec_id long, score long")
        # A query with fewer than k rows keeps them all: its range stays where it starts.
        low = np.where(short, low, low + at * width)
        width = np.where(short, 1, np.maximum(-(-width // bins), 1))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 4096, bins: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of each query by integer
    inner product, all if there are fewer, ties to the smaller vec_id.

    Both tables have vec_id (long) and v (array of long). A candidate with the query's
    own vec_id does not count. Of queries with one vec_id, the smallest vector stands; a
    candidate that is repeated may win more than one rank. Components that one of two
    vectors lacks count as 0. Scores must fit into 64 bits. Empty tables give no rows.

    The driver holds one block of ``block_rows`` queries at a time and a few numbers for
    each; what a block sends to executors is bounded by that, whatever the tables' sizes.
    """
    candidates = stored(candidates.select("vec_id", "v"), "candidates")
    # Order the queries into blocks of a bounded size without a global sort.
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n = queries.count()
    if not n:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-n // block_rows)
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition("block"), "queries")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = candidates.agg(F.max(norm2)).first()[0] or 0.0
    out = shared_path(candidates.sparkSession, "topk")
    for b in range(blocks):
        rows = queries.where(F.col("block") == b).select("vec_id", "v").orderBy("vec_id").toArrow()
        if not rows.num_rows:
            continue
        vectors = rows.column("v").combine_chunks()
        q = _matrix(vectors, max(1, int(np.diff(np.asarray(vectors.offsets)).max())))
        block = _Block(rows.column("vec_id").to_numpy(), q, k)
        reach = (np.sqrt((q.astype(np.float64) ** 2).sum(1) * longest) * (1 + 1e-9)).astype(np.int64) + 1
        best = _search_block(candidates, block, reach, bins)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
    return candidates.sparkSession.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)


def top_k_embeddings(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, **options) -> DataFrame:
    """:func:`top_k` of the vectors whose id is divisible by ``every`` against all."""
    rows = quantised(embeddings, scale)
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k, **options)
