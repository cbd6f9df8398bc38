"""Language-model scoring with Katz backoff.

Tables of n-grams hold Good-Turing discounted counts:

* a word w seen r times has P(w) = d(r) * r / N, scaled so that the words and the one
  class of unknown words, which gets n1 / N, sum to exactly 1;
* an n-gram (h, w) seen r times has P(w | h) = d(r) * r / c(h); one that was not seen has
  a(h) * P(w | h'), h' being h without its first word, where a(h) makes the sum over all
  words exactly 1. After a history that was not seen, P(w | h) = P(w | h').

The evaluation goes the same way: each token asks for its longest n-gram, and only what is
missing there goes on to the backoff weight of its history and to the next shorter one.

Two tables are written, both dealt out by the name of an n-gram: ``grams`` (order, gram, n)
and ``histories`` (order, gram, n, weight). :func:`fit` gives them as a :class:`Model`, which
scores any text; :func:`score` makes them from some rows and scores all in the same passes.

How it is spread. A chunk of documents counts its own n-grams first and sends each bucket
(a range of names) one compressed piece with every name once, so a frequent n-gram costs an
entry a chunk, however often it occurs. The bucket adds up and answers in the order of the
question. Each n-gram is given to one of the chunks that has it; that chunk says, in the same
manner, what the n-gram adds to its history, and asks for the weights that its held-out
tokens need. A bucket keeps the n-grams it has met, merged as pieces come, and the pieces;
so neither a frequent word nor a history with many followers gathers in a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, in_few_files, partition_keys, shuffle_partitions, stored

#: Words are named by their XXH64, longer n-grams by a 64-bit mix of their words' names; 0 and
#: 1 stand for an end and a start. In columns names are signed.
END, START = 0, 1
#: Counts up to this one are discounted by Good-Turing, larger ones keep TRUST of theirs.
K, TRUST = 5, 0.999
#: A chunk is named by the partition that it is scanned in and its place there.
CHUNK_SHIFT = 32
#: Characters and documents of a chunk at most, characters of text (times orders) that a
#: bucket stands for, and numbers that are merged at once.
CHUNK, CHUNK_DOCS, BUCKET, MERGE = 8_000_000, 1 << 20, 12_000_000, 2_000_000


def word_names(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    names = np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)
    return np.maximum(names, np.uint64(2))


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text, lower-cased in A-Z; the end is not among them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's d(0..K) from counts of counts n[r], r to K + 1; d(0) is not used.

    Where the counts are too few or too uneven for Good-Turing, r / (r + 1) stands in:
    any value in (0, 1) keeps the model exactly normalised.
    """
    d = np.ones(K + 1)
    top = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        d[r] = good if 0 < good < 1 else r / (r + 1)
    return d


@dataclass
class Stats:
    """What is known of all n-grams together: totals, and counts of counts by order."""

    tokens: int
    types: int
    docs: int
    counts_of_counts: list[np.ndarray]

    def __post_init__(self) -> None:
        self.d = [discounts(n) for n in self.counts_of_counts]
        n, small = self.counts_of_counts[0], np.arange(1, K + 1)
        light = self.d[0][1:] * small
        kept = float((n[1 : K + 1] * light).sum()) + TRUST * float(self.tokens - (n[1 : K + 1] * small).sum())
        self.unknown = (n[1] if n[1] else 1) / (self.tokens + (0 if n[1] else 1)) if self.tokens else 1.0
        if self.unknown >= 1 and self.tokens:  # every training token is a word of its own
            self.unknown = self.tokens / (self.tokens + 1)
        scale = (1 - self.unknown) / kept if kept else 0.0
        #: P(w) for counts to K; beyond, P(w) = heavy * count.
        self.light = np.concatenate(([self.unknown], light * scale))
        self.heavy = TRUST * scale

    @property
    def order(self) -> int:
        return len(self.d)

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        """Logarithm of a single word's probability, from its count."""
        return np.log10(np.where(counts <= K, self.light[np.minimum(counts, K)], self.heavy * counts))

    def log_kept(self, order: int, counts: np.ndarray) -> np.ndarray:
        """Logarithm of what the discount leaves of a count above 0."""
        return np.log10(np.where(counts <= K, self.d[order - 1][np.minimum(counts, K)], TRUST) * counts)

    def weights(self, order: int, sums: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Logarithms of the backoff weights of histories of n-grams of an order, from :data:`SUMS`."""
        seen, heavy, lower, lower_heavy = sums[:, :K], sums[:, K], sums[:, K + 1 : 2 * K + 1], sums[:, 2 * K + 1]
        small, d = np.arange(1, K + 1), self.d[order - 1][1:]
        # What the discounts took, summed without cancellation, and the mass below of the words seen.
        freed = (seen @ (small * (1 - d)) + (1 - TRUST) * heavy) / (seen @ small + heavy)
        if order == 2:
            mass = lower @ self.light[1:] + lower_heavy * self.heavy
        else:
            mass = (lower @ (small * self.d[order - 2][1:]) + TRUST * lower_heavy) / below
        return np.log10(freed / (1 - mass))

    def to_json(self) -> str:
        return json.dumps({"tokens": self.tokens, "types": self.types, "docs": self.docs, "counts_of_counts": [n.tolist() for n in self.counts_of_counts]})

    @classmethod
    def from_json(cls, text: str) -> Stats:
        said = json.loads(text)
        return cls(said["tokens"], said["types"], said["docs"], [np.array(n) for n in said["counts_of_counts"]])


@dataclass
class Model:
    """The tables, and the statistics of both: ``grams`` (order, gram, n) and ``histories``
    (order, gram, n, weight), whose order is that of the n-grams that they are histories of."""

    stats: Stats
    grams: DataFrame
    histories: DataFrame

    def write(self, path: str) -> None:
        """Store both tables under ``path``, partitioned by order."""
        for name in ("grams", "histories"):
            getattr(self, name).sortWithinPartitions("order", "gram").write.options(**DELTAS).partitionBy("order").parquet(f"{path}/{name}")
        self.grams.sparkSession.createDataFrame([(self.stats.to_json(),)], "stats string").write.parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Model:
        stats = Stats.from_json(spark.read.parquet(f"{path}/stats").first()[0])
        return cls(stats, *(spark.read.parquet(f"{path}/{name}") for name in ("grams", "histories")))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, training flags, names of all tokens, tokens of each document) of some documents.
    A document's last token is its end."""
    ids, train, names, size, end = [], [], [], 0, np.full(1, END, np.uint64)

    def chunk() -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        return ids, np.array(train), np.concatenate([x for own in names for x in (own, end)]), np.array([len(own) + 1 for own in names])

    for batch in batches:
        for doc, text, held in zip(*(batch.column(i) for i in range(3)), strict=True):
            value = text.as_py()
            ids.append(doc.as_py())
            train.append(not held.as_py())
            names.append(word_names(tokens_of(value)))
            size += len(value or "")
            if size > CHUNK or len(ids) >= CHUNK_DOCS:
                yield chunk()
                ids, train, names, size = [], [], [], 0
    if ids:
        yield chunk()


def _joined(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The name of an n-gram, from those of its history and its last word."""
    z = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


@dataclass
class _Tokens:
    """Tokens of a chunk: the document of each, where documents start, and by order (from 1)
    the names of its n-gram and of the history of that."""

    doc: np.ndarray
    starts: np.ndarray
    grams: list[np.ndarray]
    before: list[np.ndarray]

    @classmethod
    def of(cls, w: np.ndarray, lengths: np.ndarray, order: int) -> _Tokens:
        starts = np.cumsum(lengths) - lengths
        grams, before, start = [w], [np.zeros(0, np.uint64)], np.full(1, START, np.uint64)
        for _ in range(order - 1):
            h = np.empty_like(w)
            h[1:] = grams[-1][:-1]
            h[starts] = start
            before.append(h)
            grams.append(_joined(h, w))
            start = _joined(start, np.full(1, START, np.uint64))
        return cls(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), starts, grams, before)


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Integers with their bytes of equal weight side by side, which pack better."""
    raw = values.astype(kind)
    return raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def _narrow(names: np.ndarray) -> bytes:
    """Names in ascending order as their differences, whose high bytes are mostly zero."""
    return _planes(np.diff(names, prepend=np.uint64(0)), "<u8")


def _wide(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, "<u8"), dtype=np.uint64)


def _packed(parts: list[bytes]) -> bytes:
    head = np.array([len(p) for p in parts], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpacked(raw: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at, parts = 4 * n, []
    for size in np.frombuffer(raw[: 4 * n], "<u4").tolist():
        parts.append(raw[at : at + size])
        at += size
    return parts


def _slices(names: list[np.ndarray], buckets: int) -> Iterator[tuple[int, list[slice]]]:
    """Each bucket that one of the ascending lists has names of, and its part of every list."""
    of = [((n >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) for n in names]
    met = np.unique(np.concatenate(of))
    cuts = [(np.searchsorted(b, met), np.searchsorted(b, met, side="right")) for b in of]
    for i, b in enumerate(met.tolist()):
        yield b, [slice(int(lo[i]), int(hi[i])) for lo, hi in cuts]


class _Table:
    """Names with integers that add up and one that stays as it first came; merged as it grows."""

    def __init__(self, width: int):
        self.names, self.sums, self.first = np.zeros(0, np.uint64), np.zeros((0, width), np.int64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, names: np.ndarray, sums: np.ndarray, first: np.ndarray) -> None:
        self.held.append((names, sums, first))
        self.size += sums.size
        if self.size > MERGE + self.sums.size:
            self.settle()

    def settle(self) -> _Table:
        if self.size:
            names, sums, first = (np.concatenate(x) for x in zip((self.names, self.sums, self.first), *self.held, strict=True))
            order = np.argsort(names, kind="stable")
            names = names[order]
            new = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            self.names, self.sums, self.first = names[new], np.add.reduceat(sums[order], new, axis=0), first[order][new]
        self.held, self.size = [], 0
        return self

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it there, where) of each name."""
        if not len(self.names):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return self.names[at] == names, at


#: Kinds of rows. Of a chunk: LISTED, its documents; COUNTED, counts of its n-grams for a
#: bucket, and the bucket's answer; FOLLOWED, what its n-grams add to histories of a bucket, with
#: the weights that it asks for, and the answer; JUDGED, its documents' sums without weights.
#: GRAM and HISTORY are rows of the tables, NUMBER counts of counts (TYPES, TOKENS and DOCS too).
LISTED, COUNTED, FOLLOWED, JUDGED, GRAM, HISTORY, NUMBER = range(7)
TYPES, TOKENS, DOCS = -1, -2, -3
#: Rows of a stored table stand for a chunk of this name, which is not answered.
MODEL = -1
DEALT = pa.schema([("key", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("piece", pa.binary())])
SAID = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("order", pa.int32()), ("gram", pa.int64()), ("n", pa.int64()), ("weight", pa.float64()), ("piece", pa.binary())])
DEALT_SQL = "key int, bucket int, chunk long, kind int, piece binary"
SAID_SQL = "key int, kind int, chunk long, bucket int, order int, gram long, n long, weight double, piece binary"
#: Names are written as differences, as they ascend within a bucket.
DELTAS = {"parquet.writer.version": "v2"}
#: Of a history: how many n-grams were seen 1 to K times, the counts of those seen more often;
#: the same of the n-grams without their first word.
SUMS = 2 * (K + 1)


def _batches(schema: pa.Schema, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 1024], strict=True), schema.types, strict=True)], schema=schema)


def _table_rows(kind: int, order: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    height = len(columns["n"])
    for i in range(0, height, 1 << 17):
        size = min(1 << 17, height - i)
        whole = {"kind": pa.array(np.full(size, kind, np.int32)), "order": pa.array(np.full(size, order, np.int32))} | {c: pa.array(x[i : i + size]) for c, x in columns.items()}
        yield pa.RecordBatch.from_arrays([whole[f.name] if f.name in whole else pa.nulls(size, f.type) for f in SAID], schema=SAID)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[tuple[int, int, int, bytes]]]]:
    """Rows (chunk, kind, bucket, piece) that share a number; they come one group after another."""
    last, held = None, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("chunk", "kind", "bucket"))
        for number, *row, piece in zip(batch.column(by).to_pylist(), *columns, batch.column("piece"), strict=True):
            if number != last and held:
                yield last, held
                held = []
            last = number
            held.append((*row, piece.as_py()))
    if held:
        yield last, held


def _home(chunk: int, parts: int) -> int:
    """The partition, and the bucket of that number, that a chunk's own rows go to; those of
    neighbours are far apart, so that chunks are dealt out evenly."""
    nth = 16 * (chunk >> CHUNK_SHIFT) + (chunk & (1 << CHUNK_SHIFT) - 1)
    return int(nth * 0.6180339887498949 % 1 * parts)


def _deal(order: int, buckets: int, keys: list[int]):
    """Count a chunk's n-grams and send them to their buckets. Partitions are those of the
    scan, so a task that runs again names its chunks as before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << CHUNK_SHIFT
        for ids, train, names, lengths in _chunks(batches):
            tokens = _Tokens.of(names, lengths, order)
            learned, own = train[tokens.doc], []
            for grams in tokens.grams:
                met, at = np.unique(grams, return_inverse=True)
                own.append((met, np.bincount(at[learned], minlength=len(met))))
                if len(own) == 1:  # the names come back with the answers, in this order
                    listed = [np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), train.astype(np.uint8).tobytes(), _planes(lengths, "<u8"), _planes(at, "<u4")]
            home = _home(chunk, len(keys))
            rows = [(keys[home], home, chunk, LISTED, _packed(listed))]
            for b, cuts in _slices([met for met, _ in own], buckets):
                piece = [raw for cut, (met, counts) in zip(cuts, own, strict=True) for raw in (_narrow(met[cut]), _planes(counts[cut], "<u4"))]
                rows.append((keys[b % len(keys)], b, chunk, COUNTED, _packed(piece)))
            yield from _batches(DEALT, rows)
            chunk += 1

    return run


def _deal_table(kind: int, order: int, buckets: int, keys: list[int]):
    """Rows (order, gram, n or weight) of a stored table as pieces for their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, grams = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            value = batch.column(2).to_numpy()
            own = []
            for o in range(1 if kind == COUNTED else 2, order + 1):
                at = np.flatnonzero(of == o)
                at = at[np.argsort(grams[at])]
                own.append((grams[at], value[at]))
            rows = []
            for b, cuts in _slices([met for met, _ in own], buckets):
                piece = [raw for cut, (met, x) in zip(cuts, own, strict=True) for raw in (_narrow(met[cut]), x[cut].astype("<i8" if kind == COUNTED else "<f8").tobytes())]
                rows.append((keys[b % len(keys)], b, MODEL, kind, _packed(piece)))
            yield from _batches(DEALT, rows)

    return run


def _count(order: int, keys: list[int], emit: bool):
    """Add up a bucket's n-grams and answer its chunks: the words' names, and twice the count of
    each n-gram, and one more for the chunk that it is given to."""

    def bucket(which: int, rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        yield from _batches(SAID, [(keys[_home(chunk, len(keys))], LISTED, chunk, which, None, None, None, None, piece) for chunk, kind, _, piece in rows if kind == LISTED])
        pieces = [(chunk, piece) for chunk, kind, _, piece in rows if kind == COUNTED]
        tables = [_Table(1) for _ in range(order)]
        for i, (chunk, piece) in enumerate(pieces):
            parts = _unpacked(piece, 2 * order)
            for o, table in enumerate(tables):
                names, counts = _wide(parts[2 * o]), np.frombuffer(parts[2 * o + 1], "<i8") if chunk == MODEL else _from_planes(parts[2 * o + 1], "<u4").astype(np.int64)
                seen = counts > 0
                table.add(names[seen], counts[seen][:, None], np.full(int(seen.sum()), i))
        for o, table in enumerate(tables):
            counts = table.settle().sums[:, 0]
            if emit:
                yield from _table_rows(GRAM, o + 1, gram=table.names.view(np.int64), n=counts)
                numbers = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist()
                ends = counts[table.names == END] if o == 0 else counts[:0]
                said = [*enumerate(numbers, 1), (TYPES, len(counts)), (TOKENS, int(counts.sum())), (DOCS, int(ends.sum()))]
                yield from _batches(SAID, [(None, NUMBER, None, which, o + 1, r, n, None, None) for r, n in said if n])
        for i, (chunk, piece) in enumerate(pieces):
            if chunk == MODEL:
                continue
            parts = _unpacked(piece, 2 * order)
            answer = [parts[0]]
            for o, table in enumerate(tables):
                there, at = table.find(_wide(parts[2 * o]))
                answer.append(_planes(np.where(there, 2 * table.sums[at, 0] + (table.first[at] == i), 0) if len(table.names) else np.zeros(len(there), np.int64), "<u8"))
            yield from _batches(SAID, [(keys[_home(chunk, len(keys))], COUNTED, chunk, which, None, None, None, None, _packed(answer))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which, rows in _groups(batches, "bucket"):
            yield from bucket(which, rows)

    return run


def _classes(counts: np.ndarray, at: np.ndarray, height: int) -> list[np.ndarray]:
    """Of each of ``height`` groups: how many counts are 1 to K, and the sum of the larger ones."""
    light = [np.bincount(at[counts == r], minlength=height) for r in range(1, K + 1)]
    big = counts > K
    heavy = np.zeros(height, np.int64)
    np.add.at(heavy, at[big], counts[big])
    return [*light, heavy]


def _judge(stats: Stats, buckets: int, keys: list[int], learn: bool):
    """A chunk's sums from its counts; what its n-grams add to histories, and the weights it needs."""
    order = stats.order

    def chunk(name: int, rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        (listed,) = (piece for _, kind, _, piece in rows if kind == LISTED)
        ids, null, train, lengths, index = _unpacked(listed, 5)
        lengths = _from_planes(lengths, "<u8").astype(np.int64)
        answers = [_unpacked(piece, order + 1) for _, kind, _, piece in rows if kind == COUNTED]
        names = np.concatenate([_wide(a[0]) for a in answers])
        tokens, size = _Tokens.of(names[_from_planes(index, "<u4")], lengths, order), len(lengths)
        said = [np.concatenate([_from_planes(a[o + 1], "<u8") for a in answers]).view(np.int64) for o in range(order)]
        counts, mine = [], []
        for o, grams in enumerate(tokens.grams):
            _, where, at = np.unique(grams, return_index=True, return_inverse=True)
            counts.append(said[o][at] >> 1)
            mine.append(where[(said[o] & 1) > 0])
        # How often the history of each token was followed, by order; that of a first token by documents.
        past = [np.zeros(0, np.int64)]
        for o in range(1, order):
            c = np.empty_like(counts[0])
            c[1:] = counts[o - 1][:-1]
            c[tokens.starts] = stats.docs
            past.append(c)
        out, open_ = np.zeros(len(tokens.doc)), np.ones(len(tokens.doc), bool)
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        for o in range(order, 1, -1):
            seen = open_ & (counts[o - 1] > 0)
            out[seen] += stats.log_kept(o, counts[o - 1][seen]) - np.log10(past[o - 1][seen])
            open_ &= ~seen
            back = np.flatnonzero(open_ & (past[o - 1] > 0))
            asked.insert(0, (tokens.before[o - 1][back], tokens.doc[back]))
        out[open_] += stats.log_p(counts[0][open_])
        total = lambda x: np.bincount(tokens.doc, weights=x, minlength=size)
        base = total(np.log10((counts[0] + 1.0) / (stats.tokens + 1.0 * (stats.types + 1))))
        judged = [ids, null, train, lengths.astype("<i8").tobytes(), np.rint(total(counts[0] > 0)).astype("<i8").tobytes(), base.tobytes(), total(out).tobytes()]
        asks, adds = [], []
        for o, (histories, docs) in enumerate(asked, 2):
            met, at = np.unique(histories, return_inverse=True)
            asks.append(met)
            judged += [_planes(docs, "<u4"), _planes(at, "<u4")]
            own = mine[o - 1] if learn else mine[o - 1][:0]
            heads, at = np.unique(tokens.before[o - 1][own], return_inverse=True)
            sums = np.stack(_classes(counts[o - 1][own], at, len(heads)) + _classes(counts[o - 2][own], at, len(heads)), 1)
            below = np.zeros(len(heads), np.int64)
            if o > 2:
                below[at] = past[o - 2][own]
            adds.append((heads, sums, below))
        home = _home(name, len(keys))
        out_rows = [(keys[home], home, name, JUDGED, _packed(judged))]
        lists = [x for ask, (heads, *_) in zip(asks, adds, strict=True) for x in (ask, heads)]
        for b, cuts in _slices(lists, buckets):
            piece = []
            for ask, (heads, sums, below), x, y in zip(asks, adds, cuts[::2], cuts[1::2], strict=True):
                piece += [_narrow(ask[x]), _narrow(heads[y]), _planes(sums[y].ravel(), "<u8"), _planes(below[y], "<u8")]
            out_rows.append((keys[b % len(keys)], b, name, FOLLOWED, _packed(piece)))
        yield from _batches(DEALT, out_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _groups(batches, "chunk"):
            yield from chunk(name, rows)

    return run


def _weigh(stats: Stats, keys: list[int], emit: bool):
    """Add up a bucket's histories, make their weights and answer its chunks."""
    lower = range(2, stats.order + 1)

    def bucket(which: int, rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        yield from _batches(SAID, [(keys[_home(chunk, len(keys))], JUDGED, chunk, which, None, None, None, None, piece) for chunk, kind, _, piece in rows if kind == JUDGED])
        pieces = [(chunk, piece) for chunk, kind, _, piece in rows if kind == FOLLOWED]
        tables = [_Table(SUMS) for _ in lower]
        known: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in lower]
        for chunk, piece in pieces:
            if chunk == MODEL:
                parts = _unpacked(piece, 2 * len(tables))
                for o in range(len(tables)):
                    known[o].append((_wide(parts[2 * o]), np.frombuffer(parts[2 * o + 1], "<f8")))
                continue
            parts = _unpacked(piece, 4 * len(tables))
            for o, table in enumerate(tables):
                table.add(_wide(parts[4 * o + 1]), _from_planes(parts[4 * o + 2], "<u8").astype(np.int64).reshape(-1, SUMS), _from_planes(parts[4 * o + 3], "<u8").astype(np.int64))
        weights = []
        for o, table, given in zip(lower, tables, known, strict=True):
            table.settle()
            if given:  # of a stored model
                names, values = (np.concatenate(x) for x in zip(*given, strict=True))
                at = np.argsort(names)
                table.names = names[at]
                weights.append(values[at])
                continue
            weights.append(stats.weights(o, table.sums, table.first))
            if emit:
                n = table.sums[:, :K] @ np.arange(1, K + 1) + table.sums[:, K]
                yield from _table_rows(HISTORY, o, gram=table.names.view(np.int64), n=n, weight=weights[-1])
        for chunk, piece in pieces:
            if chunk == MODEL:
                continue
            parts, answer = _unpacked(piece, 4 * len(tables)), []
            for o, table in enumerate(tables):
                there, at = table.find(_wide(parts[4 * o]))
                answer.append((np.where(there, weights[o][at], 0.0) if len(table.names) else np.zeros(len(there))).astype("<f8").tobytes())
            if any(answer):
                yield from _batches(SAID, [(keys[_home(chunk, len(keys))], FOLLOWED, chunk, which, None, None, None, None, _packed(answer))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which, rows in _groups(batches, "bucket"):
            yield from bucket(which, rows)

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
RESULT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(stats: Stats):
    """Rows of a chunk's documents, from their sums and the weights that were asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "chunk"):
            (judged,) = (piece for _, kind, _, piece in rows if kind == JUDGED)
            parts = _unpacked(judged, 7 + 2 * (stats.order - 1))
            ids, null, train = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8) > 0, np.frombuffer(parts[2], np.uint8) > 0
            n, known, base, score = (np.frombuffer(p, t) for p, t in zip(parts[3:7], ("<i8", "<i8", "<f8", "<f8"), strict=True))
            score = score.copy()
            answers = [_unpacked(piece, stats.order - 1) for _, kind, _, piece in rows if kind == FOLLOWED]
            for o in range(stats.order - 1):
                docs, at = (_from_planes(x, "<u4") for x in parts[7 + 2 * o : 9 + 2 * o])
                weights = np.concatenate([np.zeros(0), *(np.frombuffer(a[o], "<f8") for a in answers)])
                if len(docs):
                    score += np.bincount(docs, weights=weights[at], minlength=len(ids))
            columns = [pa.array(ids, pa.int64(), mask=null), pa.array(~train), pa.array(n), pa.array(known), pa.array(np.full(len(ids), stats.tokens, np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, schema=RESULT)

    return run


def _evaluated(docs: DataFrame, held, order: int, model: Model | None = None) -> tuple[DataFrame, Model]:
    """Scores of all rows, and the model: a given one, or that of the rows that are not held out."""
    spark, learn = docs.sparkSession, model is None
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    chars = lines.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if model is not None:
        order, chars = model.stats.order, max(chars, 6 * model.stats.tokens)
    parts = shuffle_partitions(spark)
    buckets, keys = parts * max(1, -(-chars * order // (BUCKET * parts))), partition_keys(parts)

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "key").sortWithinPartitions("bucket", "chunk")

    def by_chunk(rows: DataFrame, *kinds: int) -> DataFrame:
        return rows.where(F.col("kind").isin(*kinds)).select("key", "chunk", "kind", "bucket", "piece").repartition(parts, "key").sortWithinPartitions("chunk", "bucket")

    dealt = lines.mapInArrow(_deal(order, buckets, keys), DEALT_SQL)
    if model is not None:
        dealt = dealt.unionByName(model.grams.select("order", "gram", "n").mapInArrow(_deal_table(COUNTED, order, buckets, keys), DEALT_SQL))
    counted = stored(in_few_files(by_bucket(dealt).mapInArrow(_count(order, keys, learn), SAID_SQL), chars * order, BUCKET), "grams", **DELTAS)
    if model is None:
        numbers = {(r.order, r.gram): r.n for r in counted.where(F.col("kind") == NUMBER).groupBy("order", "gram").agg(F.sum("n").alias("n")).collect()}
        of = [np.array([0.0, *(numbers.get((o, r), 0) for r in range(1, K + 2)), 0.0]) for o in range(1, order + 1)]
        stats = Stats(numbers.get((1, TOKENS), 0), numbers.get((1, TYPES), 0), numbers.get((1, DOCS), 0), of)
    else:
        stats = model.stats

    judged = by_chunk(counted, LISTED, COUNTED).mapInArrow(_judge(stats, buckets, keys, learn), DEALT_SQL)
    if model is not None:
        judged = judged.unionByName(model.histories.select("order", "gram", "weight").mapInArrow(_deal_table(FOLLOWED, order, buckets, keys), DEALT_SQL))
    weighed = stored(in_few_files(by_bucket(judged).mapInArrow(_weigh(stats, keys, learn), SAID_SQL), chars * order, BUCKET), "histories", **DELTAS)
    scored = by_chunk(weighed, JUDGED, FOLLOWED).mapInArrow(_finish(stats), RESULT_SQL)
    if model is None:
        model = Model(stats, counted.where(F.col("kind") == GRAM).select("order", "gram", "n"), weighed.where(F.col("kind") == HISTORY).select("order", "gram", "n", "weight"))
    return scored, model


def score(docs: DataFrame, held_out, order: int = 2) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with n_tokens, n_known, train_tokens, base_score, score.

    The model, of n-grams up to ``order`` (2 at least), learns from rows for which the Column
    ``held_out`` is not true, and scores all. A null or blank text is its end alone; a repeated
    row counts as often as it is there, and each of its rows is scored. With no training rows,
    everything is one class of unknown words, of probability 1. Other columns are left out; an
    empty table gives no row. Words and n-grams are told apart by 64 bits of hash: at 10 ** 9
    different ones less than one pair is expected to be taken for one.
    """
    return _evaluated(docs, F.coalesce(held_out, F.lit(False)), order)[0]


def fit(docs: DataFrame, order: int = 2) -> Model:
    """The model of all rows of ``docs`` (doc_id, text)."""
    return _evaluated(docs, F.lit(False), order)[1]


def score_with(model: Model, docs: DataFrame) -> DataFrame:
    """:func:`score` of rows that a model has not learned from; all are said to be held out."""
    return _evaluated(docs, F.lit(True), model.stats.order, model)[0]


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2, order: int = 2) -> DataFrame:
    """:func:`score` with the rows whose crc32 of doc_id has the given remainder held out.
    A row without an id is not held out."""
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, order)
