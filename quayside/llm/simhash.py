"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint is the bitwise majority of its shingles' XXH64. Fingerprints
(each once, whatever the number of its documents) are joined with themselves: two of
them that differ in at most ``budget`` bits have a whole segment in common when the
64 bits are cut into budget + 1 segments, and within the rest, again, a whole segment.
So each of (budget + 1) ** 2 bit orders has the shared bits first; rows of an order are
dealt out by them. In a task the rows of one order, sorted, are a binary trie whose nodes
are ranges; pairs of nodes are walked down together, differing bits add up, and a pair is
left as soon as its sum exceeds the budget. A second level of segments keeps a large
cluster of near copies, which agrees in most bits, from falling in one task.

Tasks send on a spanning forest of the links that they find; that keeps components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, in_slices, shuffle_partitions, stored
from .components import connected_components

BITS = 64
#: Words of a document that are hashed at once.
CHUNK = 1 << 16
#: Rows of bit orders that a task should hold.
TASK_ROWS = 2_000_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the hashes of the text's shingles; 0 if it has no word."""
    if not text:
        return 0
    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[: len(tokens) - words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    n = len(stops)
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, n, CHUNK):
        joined = b"".join([digest(line[a:b], seed) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(joined, np.uint8)).reshape(-1, BITS)
        counts += bits.sum(0, dtype=np.int64)
    out = 0
    for bit in (2 * counts > n).tolist():  # digests are big-endian: the highest bit first
        out = out << 1 | bit
    return out


def with_fingerprint(docs: DataFrame, column: str = "fp", words: int = 3) -> DataFrame:
    """Add the fingerprint of ``text`` as a signed 64-bit integer."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words) for some in in_slices(texts) for t in some], dtype=np.uint64).view(np.int64))

    return docs.withColumn(column, of("text"))


@cache
def bit_orders(budget: int) -> list[tuple[int, int, list[int]]]:
    """(mask of the shared bits, their number, bit positions from first to last) of each order."""

    def cut(bits: list[int]) -> list[list[int]]:
        n = budget + 1
        return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]

    orders = []
    for first in cut(list(range(BITS))):
        rest = [b for b in range(BITS) if b not in first]
        for second in cut(rest):
            shared = first + second
            orders.append((sum(1 << (BITS - 1 - b) for b in shared), len(shared), shared + [b for b in rest if b not in second]))
    return orders


def permuted(values: np.ndarray, order: list[int]) -> np.ndarray:
    """The bits of ``values`` (uint64) in another order, the first bit highest."""
    out = np.zeros(len(values), np.uint64)
    start = 0
    while start < BITS:  # move runs of neighbouring bits at once
        stop = start + 1
        while stop < BITS and order[stop] == order[stop - 1] + 1:
            stop += 1
        run = (values >> np.uint64(BITS - 1 - order[stop - 1])) & np.uint64((1 << (stop - start)) - 1)
        out |= run << np.uint64(BITS - stop)
        start = stop
    return out


def trie_pairs(values: np.ndarray, shared: int, budget: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted distinct uint64 ``values`` that agree in the first
    ``shared`` bits and differ in 1 to ``budget`` of the others, in blocks.

    The trie over the values is implicit: a node at depth d is a range of values with
    equal first d bits. At most about ``most`` node pairs are held a level.
    """
    n = len(values)
    if n < 2:
        return
    keys = values >> np.uint64(BITS - shared)
    edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [n]))
    lo, hi = edges[:-1], edges[1:]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    # Ones before each row, by depth: they split a range without a search.
    ones: dict[int, np.ndarray] = {}

    def split(depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if depth not in ones:
            bit = ((values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int32)
            ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
        c = ones[depth]
        return b - (c[b] - c[a])

    stack = [(shared, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, a, b, c, d, spent = stack.pop()
        if not len(a):
            continue
        if len(a) > most:
            half = len(a) // 2
            stack += [(depth, a[half:], b[half:], c[half:], d[half:], spent[half:]), (depth, a[:half], b[:half], c[:half], d[:half], spent[:half])]
            continue
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            i, j = a[single], c[single]
            other = i != j
            i, j = i[other], j[other]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            if near.any():
                yield i[near], j[near]
            a, b, c, d, spent = (x[~single] for x in (a, b, c, d, spent))
        if depth == BITS or not len(a):
            continue
        same = a == c
        m, k = split(depth, a, b), split(depth, c, d)
        mixed = spent < budget
        cross = mixed & ~same
        parts = [
            (a, m, c, k, spent, slice(None)),
            (m, b, k, d, spent, slice(None)),
            (a, m, k, d, spent + 1, mixed),  # of a node with itself, once
            (m, b, c, k, spent + 1, cross),
        ]
        joined = [np.concatenate([np.asarray(p[x])[p[5]] for p in parts]) for x in range(5)]
        full = (joined[1] > joined[0]) & (joined[3] > joined[2])
        # A node with itself of one row has no pair.
        full &= (joined[0] != joined[2]) | (joined[1] - joined[0] > 1)
        stack.append((depth + 1, *(x[full] for x in joined)))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest one that it is linked with, directly or not."""
    label = np.arange(n)

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]

    for i, j in pairs:
        settle(i, j)
    return label


def linked(fps: DataFrame, budget: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints, column ``fp``, that keep the connected
    components of all pairs at ``budget`` or fewer differing bits."""
    orders = bit_orders(budget)
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m, _, _ in orders])
    rows = fps.select("fp", F.posexplode(masks).alias("order", "mask")).select("fp", "order", F.xxhash64("order", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    parts = max(shuffle_partitions(fps.sparkSession), -(-fps.count() * len(orders) // TASK_ROWS))
    dealt = rows.repartition(parts, "order", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not columns:
            return
        fp, of = (np.concatenate(x) for x in zip(*columns, strict=True))
        fp = fp.view(np.uint64)
        for at, (_, shared, order) in enumerate(orders):
            own = fp[of == at]
            if len(own) < 2:
                continue
            turned = permuted(own, order)
            by = np.argsort(turned)
            own, turned = own[by], turned[by]
            label = forest(len(own), trie_pairs(turned, shared, budget))
            moved = np.flatnonzero(label != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[label[moved]].view(np.int64)), pa.array(own[moved].view(np.int64))], names=["a", "b"])

    return dealt.select("fp", "order").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 2, words: int = 3, keep: tuple[str, ...] = (), rooted: bool = False) -> DataFrame:
    """doc_id, fp, component_id and the columns ``keep`` of every row of ``docs`` (doc_id, text),
    and, if ``rooted``, root: a fingerprint that names the component, where ids are null or repeat.

    component_id is the smallest doc_id that is reached over links of at most ``budget``
    differing bits, the row's own included. Rows with equal fingerprints belong together,
    so do repeated rows. Null, empty and blank texts all have fingerprint 0, which is
    linked like any other. A null doc_id is never the smallest; a component of nothing
    else has a null id. An empty table gives no row.
    """
    prints = stored(with_fingerprint(docs.select("doc_id", "text", *[F.col(c).alias(f"_{c}") for c in keep]), "fp", words).drop("text"), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = stored(distinct, "classes")
    roots = connected_components(linked(distinct, budget)).select(F.col("node").alias("fp"), "root")
    classes = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # A component may have many classes: the minimum is made by a partial aggregate.
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", *[F.col(f"_{c}").alias(c) for c in keep], *(["root"] if rooted else []))


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """The contract's form: the fingerprint as 16 lowercase hexadecimal digits."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
