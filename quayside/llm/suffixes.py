"""Removal of repeated byte strings by a distributed suffix array.

Two strings of ``size`` bytes can only be equal if the smallest hash among their k-byte
substrings is the same, at the same place. So each window of ``size`` bytes is named by
its minimizer, and

1. minimizers that occur once in the corpus are dropped with all their windows;
2. the windows of the others, neighbours with one minimizer as one piece of text, are
   dealt out by minimizer; a piece that occurs again as a whole is settled there and then,
   within a batch of documents already before the shuffle;
3. a task sorts the suffixes of its pieces in two stages: those smaller than their
   successor directly, the others by one scan over the buckets of first bytes, in which
   every suffix puts its predecessor in the next free place. Common prefixes of neighbours
   in that order say which windows are equal, and all but the first are marked.

Windows of a minimizer with more than ``HOT`` places are dealt out finer: by how far their
minimizer is from their start, in ``FINE`` steps, and by the bytes that all windows of
that step share; so a frequent line is parted by what it stands next to. Where more than
``CROWD`` different pieces still share a key, their windows go one by one, by all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_few_files, shuffle_partitions, stored

#: Bytes of a minimizer; a power of two.
KMER = 32
HOT, FINE, CROWD = 1000, 12, 20_000
#: Bytes of documents that are handled at once, of a long document's parts, and of a suffix array.
BATCH, PART, BLOCK = 2_500_000, 1_000_000, 2_000_000
#: Minimizers of a task's share of a written table, at least.
MARKS = 300_000
NO_ID = -(1 << 63)


def _hashes(x: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of the given lengths (powers of two)."""
    h, size, out = x.astype(np.uint64) + np.uint64(1), 1, {}
    while size < max(lengths):
        h = (h[:-size] ^ (h[:-size] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[size:] if len(h) > size else h[:0]
        size *= 2
        if size in lengths:
            out[size] = _mixed(h)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _minima(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: -(width - size)], v[width - size :]) if size < width else v


@dataclass
class _Bytes:
    """Parts of documents, one after another, with the minimizer of each window."""

    raw: bytes
    row: np.ndarray  # of each part
    base: np.ndarray  # its place in its document
    starts: np.ndarray
    ends: np.ndarray
    part: np.ndarray  # of each window
    at: np.ndarray  # the place of each window's minimizer in raw
    fits: np.ndarray  # does the window lie within its part?
    hashes: dict[int, np.ndarray]

    @classmethod
    def of(cls, parts: list[tuple[int, int, bytes]], size: int, lengths: list[int]) -> _Bytes:
        raw = b"".join(p[2] for p in parts)
        x = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(p[2]) for p in parts])
        starts = ends - np.array([len(p[2]) for p in parts])
        hashes = _hashes(x, sorted({KMER, *lengths}))
        order = hashes[KMER]
        # Of equal hashes in a window the first counts.
        at = (_minima(order >> np.uint64(32) << np.uint64(32) | np.arange(len(order), dtype=np.uint64), size - KMER + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), ends - starts)[: len(at)]
        fits = np.arange(len(at)) + size <= ends[part]
        return cls(raw, np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), starts, ends, part, at, fits, hashes)

    def place(self, i: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Places in documents of places in raw."""
        return i - self.starts[part] + self.base[part]


def _parts(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """A long text in parts that share size - 1 bytes, so that each window lies in one part."""
    for i in range(0, max(len(text) - size + 1, 0), PART):
        yield i, text[i : i + PART + size - 1]


def _minimizers(size: int):
    """(hash, doc, place) of the minimizers of each text's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            b = _Bytes.of(parts, size, [])
            new = b.fits.copy()
            new[1:] &= (b.at[1:] != b.at[:-1]) | (b.part[1:] != b.part[:-1]) | ~b.fits[:-1]
            at, part = b.at[new], b.part[new]
            columns = (b.hashes[KMER][at].view(np.int64), np.array(docs)[b.row[part]], b.place(at, part))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "doc", "place"])

        parts, docs, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                for base, piece in _parts((text.as_py() or "").encode("utf-8", "surrogatepass"), size):
                    parts.append((len(docs) - 1, base, piece))
                    held += len(piece)
                    if held > BATCH:
                        yield from flush()
                        parts, docs, held = [], [doc], 0
        if parts:
            yield from flush()

    return run


PIECES = "key long, doc long, place long, n int, content binary"


def _piece_batch(key, doc, place, n, content) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int32()), pa.array(content, pa.binary())], names=["key", "doc", "place", "n", "content"])


def _pieces(size: int):
    """Pieces of text with their windows' key, from texts with the marks of their repeated
    minimizers (twice the place, and one more if it is hot). A row without content says
    that n bytes from its place are repeated."""
    core = size - FINE + 1  # bytes that all windows of a fine step share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            b = _Bytes.of([p[:3] for p in parts], size, [64])
            level = np.zeros(len(b.raw), np.uint8)
            for j, (_, base, piece, marks) in enumerate(parts):
                own = marks // 2 - base
                inside = (own >= 0) & (own < len(piece))
                level[b.starts[j] + own[inside]] = 1 + (marks[inside] & 1)
            windows = np.arange(len(b.at))
            which = np.where(b.fits, level[b.at], 0)
            step = np.where(which == 2, (b.at - windows) // FINE, 0)
            live = which > 0
            first, last = live.copy(), live.copy()
            change = (b.at[1:] != b.at[:-1]) | (step[1:] != step[:-1]) | (b.part[1:] != b.part[:-1])
            first[1:] &= change | ~live[:-1]
            last[:-1] &= change | ~live[1:]
            lo, hi = np.flatnonzero(first), np.flatnonzero(last)
            if not len(lo):
                return
            at, h64 = b.at[lo], b.hashes[64]
            key = b.hashes[KMER][at].copy()
            fine = which[lo] == 2
            if fine.any():
                s = at[fine] - step[lo][fine] * FINE  # the latest start of a window of this step
                a = _mixed(h64[s] + np.uint64(3) * _mixed(h64[s + core - 64]))
                key[fine] = _mixed(key[fine] + _mixed(a + step[lo][fine].astype(np.uint64)))
            part = b.part[lo]
            doc = np.array(docs)[b.row[part]]
            place = b.place(lo, part)
            n = hi - lo + 1
            # Of equal pieces of this batch, all but the first are repeated as a whole.
            stop = hi + size
            spread = _mixed(h64[lo] + np.uint64(5) * _mixed(h64[stop - 64])) + _mixed(key + n.astype(np.uint64))
            order = np.lexsort((place, doc, spread))
            kept = np.ones(len(order), bool)
            run_starts = np.flatnonzero(np.concatenate(([True], spread[order][1:] != spread[order][:-1])))
            for i, j in zip(run_starts.tolist(), [*run_starts[1:].tolist(), len(order)], strict=True):
                if j - i == 1:
                    continue
                seen = set()
                for k in order[i:j].tolist():
                    text = b.raw[lo[k] : stop[k]]
                    if text in seen:
                        kept[k] = False
                    seen.add(text)
            yield _piece_batch(key[kept].view(np.int64), doc[kept], place[kept], n[kept], [b.raw[a:z] for a, z in zip(lo[kept].tolist(), stop[kept].tolist(), strict=True)])
            # Repeated pieces overlap their neighbours, so runs of them become one span.
            gone = np.flatnonzero(~kept)
            if len(gone):
                begins = np.concatenate(([True], (part[gone][1:] != part[gone][:-1]) | (lo[gone][1:] > stop[gone][:-1])))
                a, z = gone[begins], gone[np.append(np.flatnonzero(begins)[1:], len(gone)) - 1]
                yield _piece_batch(key[a].view(np.int64), doc[a], place[a], stop[z] - lo[a], [None] * len(a))

        parts, docs, held = [], [], 0
        for batch in batches:
            for doc, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = marks.values.to_numpy()
                docs.append(doc)
                for base, piece in _parts((text.as_py() or "").encode("utf-8", "surrogatepass"), size):
                    parts.append((len(docs) - 1, base, piece, own))
                    held += len(piece)
                    if held > BATCH:
                        yield from flush()
                        parts, docs, held = [], [doc], 0
        if parts:
            yield from flush()

    return run


def _single(size: int):
    """Pieces of one window each, keyed by its bytes, from longer pieces. Of equal windows of
    a batch only the first leaves the task, so a key has one row a task and batch at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, tuple[int, int]] = {}
            gone: list[tuple[int, int]] = []
            for doc, place, n, content in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                for i in range(n):
                    window, here = content[i : i + size], (doc, place + i)
                    there = first.setdefault(window, here)
                    if there != here:
                        first[window] = min(here, there)
                        gone.append(max(here, there))
            windows = list(first)
            keys = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True) for w in windows]
            places = list(first.values())
            yield _piece_batch(keys, [d for d, _ in places], [p for _, p in places], [1] * len(keys), windows)
            if gone:
                yield _piece_batch([0] * len(gone), [d for d, _ in gone], [p for _, p in gone], [size] * len(gone), [None] * len(gone))

    return run


#: Symbols of 9 bits in a word: 0 ends a piece, 1 to 256 are its bytes.
PACKED = 7


class SuffixArray:
    """The order of the suffixes of several pieces that start at chosen places.

    Suffixes are compared to the end of their piece, or for ``depth`` symbols at least.
    """

    def __init__(self, pieces: list[bytes], starts: np.ndarray, depth: int):
        """``starts``: of each piece, how many of its first places count."""
        lengths = np.array([len(p) for p in pieces]) + 1
        self.depth = depth
        self.begin = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        t = np.zeros(n + PACKED, np.uint16)
        inner = np.ones(n, bool)
        inner[self.begin + lengths - 1] = False
        t[:n][inner] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
        self.t = t
        # Words of PACKED symbols; what follows the end of a piece does not count.
        w = np.zeros(n, np.uint64)
        alive = np.ones(n, bool)
        for k in range(PACKED):
            symbol = t[k : n + k]
            w = w << np.uint64(9) | np.where(alive, symbol, 0).astype(np.uint64)
            alive &= symbol > 0
        self.word = np.concatenate((w, np.zeros(depth + PACKED, np.uint64)))
        self.chosen = np.zeros(n, bool)
        for at, k in zip(self.begin.tolist(), starts.tolist(), strict=True):
            self.chosen[at : at + k] = True
        # Smaller than its successor? Equal symbols take the answer of the next place.
        rises = t[: n - 1].astype(np.int32) - t[1:n]
        known = np.where(rises != 0, np.arange(n - 1), n)
        following = np.minimum.accumulate(known[::-1])[::-1]
        small = np.zeros(n, bool)
        inside = following < n
        small[: n - 1][inside] = rises[following[inside]] < 0
        small[~inner] = True  # the end of a piece is smaller than anything
        self.small = small
        # To put a suffix in its place, its successors are needed up to the next small one.
        need = self.chosen.copy()
        edge = np.flatnonzero(need & ~small)
        while len(edge):
            edge = edge[~need[edge + 1]] + 1
            need[edge] = True
            edge = edge[~small[edge]]
        self.need = need
        self.order = self._induced(self._sorted(np.flatnonzero(need & small)))

    def _sorted(self, at: np.ndarray) -> np.ndarray:
        """Direct sorting, a word at a time, of what is still tied."""
        if len(at) < 2:
            return at
        at = at[np.argsort(self.word[at], kind="stable")]
        key = self.word[at]
        tied = np.concatenate(([False], key[1:] == key[:-1]))
        ahead = PACKED
        while ahead < self.depth and tied.any():
            either = tied.copy()
            either[:-1] |= tied[1:]
            rows = np.flatnonzero(either)
            group = np.cumsum(~tied)[rows]
            key = self.word[at[rows] + ahead]
            # A tie that has reached its end stays one.
            by = np.lexsort((key, group))
            at[rows] = at[rows[by]]
            key = key[by]
            same = np.concatenate(([False], (group[1:] == group[:-1]) & (key[1:] == key[:-1]) & (key[1:] != 0)))
            tied = np.zeros(len(at), bool)
            tied[rows] = same
            ahead += PACKED
        return at

    def _induced(self, direct: np.ndarray) -> np.ndarray:
        """One scan over the buckets: each suffix places its predecessor, if that is larger than it."""
        t = self.t
        first = t[direct]
        edges = np.searchsorted(first, np.arange(258))
        waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
        out = []
        pushes = self.need & ~self.small  # those that are placed by their successor
        for c in range(257):
            bucket = list(waiting[c])
            ring = np.concatenate(bucket) if bucket else direct[:0]
            while len(ring):  # runs of one symbol place each other
                before = ring[ring > 0] - 1
                ring = before[pushes[before] & (t[before] == c)]
                if len(ring):
                    bucket.append(ring)
            bucket.append(direct[edges[c] : edges[c + 1]])
            whole = np.concatenate(bucket)
            if not len(whole):
                continue
            out.append(whole)
            before = whole[whole > 0] - 1
            before = before[pushes[before] & (t[before] > c)]
            if not len(before):
                continue
            symbol = t[before]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            cuts = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
            for a, z in zip(cuts, [*cuts[1:], len(before)], strict=True):
                waiting[symbol[a]].append(before[a:z])
        return np.concatenate(out) if out else direct

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share, to ``depth`` at most."""
        out = np.zeros(len(a), np.int32)
        rows = np.arange(len(a))
        for ahead in range(0, self.depth, PACKED):
            x = self.word[a[rows] + ahead] ^ self.word[b[rows] + ahead]
            same = x == 0
            part = np.full(len(rows), PACKED, np.int32)
            for k in range(PACKED):  # the first symbol in which they differ
                part[(x >> np.uint64(9 * (PACKED - 1 - k)) != 0) & (part == PACKED)] = k
            out[rows] = ahead + part
            rows = rows[same]
            if not len(rows):
                break
        return np.minimum(out, self.depth)


def _repeated(doc: np.ndarray, place: np.ndarray, n: np.ndarray, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place, bytes) of what is repeated, from distinct pieces of n windows each."""
    array = SuffixArray(pieces, n, size)
    order = array.order[array.chosen[array.order]]
    if not len(order):
        return doc[:0], place[:0], n[:0]
    piece = np.searchsorted(array.begin, order, side="right") - 1
    own_place = place[piece] + order - array.begin[piece]
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((own_place, doc[piece]))] = np.arange(len(order))
    equal = np.concatenate(([False], array.common_prefix(order[:-1], order[1:]) >= size))
    heads = np.flatnonzero(~equal)
    earliest = np.minimum.reduceat(rank, heads)[np.cumsum(~equal) - 1]
    hit = np.sort(order[rank != earliest])
    piece = np.searchsorted(array.begin, hit, side="right") - 1
    new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (piece[1:] != piece[:-1]))) if len(hit) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1 if len(first) else first
    return doc[piece[first]], place[piece[first]] + hit[first] - array.begin[piece[first]], hit[last] - hit[first] + size


def _settle(size: int):
    """(doc, place, n): n bytes from a place are repeated. Rows come in the order of keys."""

    def spans(doc, place, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64())], names=["doc", "place", "n"])

    def block(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        whole = []
        for key, doc, place, n, content in rows:
            before = first.setdefault((key, content), (doc, place, n))
            if before[:2] > (doc, place):
                first[key, content] = (doc, place, n)
                whole.append((before[0], before[1], n + size - 1))
            elif before[:2] < (doc, place):
                whole.append((doc, place, n + size - 1))
        if whole:
            yield spans(*zip(*whole, strict=True))
        # A piece that is alone under its key has nothing to be compared with.
        beside: dict[int, int] = {}
        for key, _ in first:
            beside[key] = beside.get(key, 0) + 1
        met = [(content, *where) for (key, content), where in first.items() if beside[key] > 1]
        if met:
            pieces, doc, place, n = zip(*met, strict=True)
            found = _repeated(np.array(doc), np.array(place), np.array(n), list(pieces), size)
            if len(found[0]):
                yield spans(*found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held > BLOCK and row[0] != last:
                    yield from block(rows)
                    rows, held = [], 0
                last = row[0]
                rows.append(row)
                held += len(row[4])
        if rows:
            yield from block(rows)

    return run


def repeated_spans(docs: DataFrame, size: int = 100) -> DataFrame:
    """(doc, place, n) of repeated bytes in ``docs`` (doc, text), overlapping and in no order.
    Numbers of documents differ, and say which is earlier."""
    marks = stored(docs.select("doc", "text").mapInArrow(_minimizers(size), "h long, doc long, place long"), "minimizers")
    n = marks.count()
    # A table of its own, so that a join with it can split a frequent minimizer's rows.
    often = marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot"))
    often = stored(in_few_files(often, n, MARKS), "repeated")
    mark = F.col("place") * 2 + F.col("hot").cast("long")
    kept = marks.join(often, "h").groupBy("doc").agg(F.collect_list(mark).alias("marks"))
    kept = stored(in_few_files(kept, n, MARKS), "marks")
    discard(marks)
    pieces = docs.join(kept, "doc").select("doc", "text", "marks").mapInArrow(_pieces(size), PIECES)
    pieces = stored(in_few_files(pieces, n, MARKS), "pieces")
    parts = shuffle_partitions(docs.sparkSession)
    crowded = pieces.where(F.col("content").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).where(F.col("pieces") > CROWD).select("key")
    spans = [pieces.where(F.col("content").isNull()).select("doc", "place", F.col("n").cast("long").alias("n"))]
    whole = pieces.where(F.col("content").isNotNull())
    if crowded.limit(1).count():
        crowded = stored(crowded, "crowded")
        single = stored(whole.join(crowded, "key", "left_semi").select(*pieces.columns).mapInArrow(_single(size), PIECES), "windows")
        whole = whole.join(crowded, "key", "left_anti").select(*pieces.columns)
        spans += [single.where(F.col("content").isNull()).select("doc", "place", F.col("n").cast("long").alias("n")), _later(single.where(F.col("content").isNotNull()), size)]
    dealt = whole.repartition(parts, "key").sortWithinPartitions("key")
    out = dealt.mapInArrow(_settle(size), "doc long, place long, n long")
    for more in spans:
        out = out.unionByName(more)
    return out


def _later(windows: DataFrame, size: int) -> DataFrame:
    """Spans of all windows but the first of equal ones. The first is a partial minimum, and
    one row a window to be joined, so a window that is everywhere may be split over tasks."""
    here = F.struct("doc", "place")
    first = windows.groupBy("content").agg(F.min(here).alias("first"))
    return windows.join(first, "content").where(here > F.col("first")).select("doc", "place", F.lit(size).cast("long").alias("n"))


def without_spans(text: str | None, places, lengths) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, removed runs) of a text and its repeated spans."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if places is None or not len(places):
        return raw, 0, 0
    a = np.asarray(places)
    order = np.argsort(a, kind="stable")
    a = a[order]
    z = np.maximum.accumulate(a + np.asarray(lengths)[order])
    new = np.concatenate(([True], a[1:] > z[:-1]))
    starts, stops = a[new], np.append(z[:-1][new[1:]], z[-1])
    kept, at = [], 0
    for x, y in zip(starts.tolist(), stops.tolist(), strict=True):
        kept.append(raw[at:x])
        at = y
    kept.append(raw[at:])
    return b"".join(kept), int((stops - starts).sum()), len(starts)


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): doc_id as a number, or, where rows share one, a number of each row
    in the order of (doc_id, hash of the text), nulls first.

    Rows are numbered by ranges of that order side by side, so that many rows of one id, or
    copies of one text, are no task of their own."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    if not rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return rows.select("doc", "doc_id", "text")
    order = ["doc", "_h", "_row"]
    ordered = rows.withColumns({"_h": F.xxhash64(F.coalesce("text", F.lit(""))), "_row": F.monotonically_increasing_id()})
    ranged = stored(ordered.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    starts, at = [], 0
    for part, n in sorted((r["_part"], r.n) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a partition
        starts.append((part, at))
        at += n
    offsets = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbers = ranged.select("_part", *order).withColumn("_nth", nth).join(offsets, "_part")
    numbers = stored(numbers.select(*order, (F.col("_start") + F.col("_nth")).alias("_number")), "numbers")
    return stored(ranged.join(numbers, order).select(F.col("_number").alias("doc"), "doc_id", "text"), "numbered")


def deduplicated(docs: DataFrame, size: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    A byte is removed if a string of ``size`` bytes that covers it also starts earlier: in
    a document of a smaller doc_id, or before in the same one. Null is an empty text; a null
    doc_id comes before all others. Rows that share a doc_id follow each other in the order
    of their texts' XXH64 (seed 42, signed), so of equal rows one stays. Other columns are left
    out; an empty table gives no row.
    """
    rows = _numbered(docs)
    spans = repeated_spans(rows.select("doc", "text"), size).groupBy("doc").agg(F.collect_list(F.struct("place", "n")).alias("spans"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def of(texts, places, lengths):
        import pandas as pd

        said = []
        for text, p, n in zip(texts, places, lengths, strict=True):
            kept, removed, runs = without_spans(text, p, n)
            said.append((len(kept) + removed, removed, runs, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(said, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.join(spans, "doc", "left").select("doc_id", of("text", "spans.place", "spans.n").alias("r")).select("doc_id", "r.*")
