"""Best-fit packing under conflicts.

Documents are cut into pieces of at most ``capacity`` bytes and placed in bins of that
size. Two pieces of one source, or of one cluster of duplicates, never share a bin. Bins
are kept in the order of their residual space and carry bitmaps of the sources and the
clusters that they hold; a piece goes to the tightest bin that takes it, found by a
search that starts at the first bin of enough room and goes on to the next until one is
compatible. Longest pieces come first.

The search is sequential, so documents are dealt out to shards of about ``shard_rows``
rows by a hash of what identifies them: a hot source or cluster is spread over all shards,
a shard has a bounded number of rows, and its bins do not depend on how tasks are dealt.
A shard's rows hold no texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .simhash import near_duplicates


class Bins:
    """Open bins in the order of (residual, bin), with bitmaps of what they hold."""

    def __init__(self, capacity: int, smallest: int):
        self.capacity, self.smallest = capacity, smallest
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.sizes: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece; ``source`` and ``cluster`` are bit masks, 0 for none."""
        at = bisect_left(self.order, (size, -1))
        sources, clusters, order = self.sources, self.clusters, self.order
        for i in range(at, len(order)):
            residual, b = order[i]
            if not (sources[b] & source or clusters[b] & cluster):
                del order[i]
                break
        else:
            b, residual = len(self.sizes), self.capacity
            self.sizes.append(0)
            sources.append(0)
            clusters.append(0)
        offset = self.sizes[b]
        self.sizes[b] += size
        sources[b] |= source
        clusters[b] |= cluster
        if residual - size >= self.smallest:  # a bin that can take nothing more is closed
            insort(order, (residual - size, b))
        return b, offset


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces come in the order in which they are placed.

    ``sources`` and ``clusters`` are small numbers, -1 for none.
    """
    bins = Bins(capacity, max(1, min(sizes, default=1)))
    # Only a cluster of two pieces or more can be in conflict.
    counts = np.bincount(np.array(clusters, np.int64) + 1) if clusters else np.zeros(1, int)
    bit = {int(c): 1 << i for i, c in enumerate(np.flatnonzero(counts[1:] > 1))}
    return [bins.place(size, 1 << s if s >= 0 else 0, bit.get(c, 0)) for size, s, c in zip(sizes, sources, clusters, strict=True)]


def _pack_shard(capacity: int):
    def run(shard: pa.Table) -> pa.Table:
        order = shard.sort_by([("n_bytes", "descending"), ("doc_id", "ascending"), ("h", "ascending"), ("piece", "ascending")])
        codes = [order.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_pylist() for c in ("source", "cluster")]
        placed = pack(order.column("n_bytes").to_pylist(), *codes, capacity)
        columns = {c: order.column(c) for c in ("doc_id", "piece", "n_bytes", "shard")}
        columns["bin"] = pa.array([b for b, _ in placed], pa.int32())
        columns["offset"] = pa.array([o for _, o in placed], pa.int32())
        return pa.table(columns)

    return run


def best_fit(docs: DataFrame, capacity: int = 8192, shard_rows: int = 2500, cluster: Column | None = None, near: bool = False) -> DataFrame:
    """doc_id, piece, n_bytes, bin_id, offset: where each piece of each row of ``docs``
    (doc_id, text, source) lies.

    A text of n UTF-8 bytes has ceil(n / capacity) pieces, full ones but for the last;
    a null or empty text has one piece of no bytes. Of a text of several pieces each is in
    a bin of its own, as they are of one source and cluster. Without a source there is no
    conflict of sources; ``cluster`` says which rows are duplicates (equal texts by
    default), null for none; with ``near`` those are the components of near duplicates. bin_id is "<shard>-<bin>". Repeated rows are placed each for
    itself; other columns are left out; an empty table gives no row.
    """
    own = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", "text", F.octet_length(own).alias("n"), F.col("source").cast("string").alias("source"), (F.xxhash64(own) if cluster is None else cluster).alias("cluster"), F.xxhash64(own).alias("h"))
    if near:
        slim = near_duplicates(slim, keep=("n", "source", "h"), rooted=True).withColumnRenamed("root", "cluster")
    slim = slim.select("doc_id", "n", "source", "cluster", "h")
    pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int") - 1))
    slim = slim.withColumn("piece", pieces).withColumn("n_bytes", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int")).drop("n")
    slim = stored(slim, "pieces")
    # Dealt out by all that identifies a piece, so that no source or cluster gathers in a shard.
    shards = max(1, -(-slim.count() // shard_rows))
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(shards)).cast("int"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, n_bytes int, shard int, bin int, offset int"
    packed = dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), schema)
    return packed.select("doc_id", "piece", "n_bytes", F.concat_ws("-", "shard", "bin").alias("bin_id"), "offset")
