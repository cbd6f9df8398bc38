"""Language identification by nearest centroid.

Texts become unit vectors of TF-IDF weighted byte n-grams (their letters only, hashed
into ``DIMENSIONS`` slots). Each language has several centroids, found by spherical
k-means, since prose, shouting and junk-laden texts of one language lie apart. A text
takes the language of the centroid of largest cosine. It is rejected if its cosine is
further below that centroid's own training texts than the centroid's margin allows; the
margin widens for short texts, whose few n-grams are far from any centroid by chance.

The classifier is fitted on a bounded sample of labelled rows (``sample`` of each language,
``most`` in all, chosen by a hash of the text); every row is predicted from its whole text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, stored

DIMENSIONS = 1 << 12
#: Bytes that are counted at once.
CHUNK = 1 << 20
#: A text of so many different n-grams has half of the margin's full reach.
SHORT = 300
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case, every other ASCII byte a blank; bytes of other letters stay.
_FOLD = np.array([32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if b < 97 else b for b in range(256)], np.uint8)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of two to four bytes, within and at the ends of words."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(DIMENSIONS, np.int64)
    carry = np.array([32, 32, 32], np.uint8)
    for i in range(0, len(raw), CHUNK):
        part = _FOLD[raw[i : i + CHUNK]]
        x = np.concatenate((carry, part)) if i + CHUNK < len(raw) else np.concatenate((carry, part, [np.uint8(32)]))
        keep = (x != 32) | np.concatenate(([True], x[:-1] != 32))  # runs of blanks as one
        known = int(keep[: len(carry)].sum())
        x = x[keep].astype(np.uint32)
        grams = x
        for n in (2, 3, 4):
            if len(x) < n:
                break
            grams = grams[:-1] << 8 | x[n - 1 :]
            new = grams[max(0, known - n + 1) :]  # those that end in this chunk
            slot = ((new + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(slot, minlength=DIMENSIONS)
        carry = x[-3:].astype(np.uint8) if len(x) >= 3 else carry
    return counts


def term_frequencies(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    """Has the text a character of Unicode's letters? Digits and fractions of other scripts are none."""
    return bool(text) and any(found.group().isalpha() for found in _LETTER.finditer(text))


@dataclass
class Centroids:
    """idf by slot; centroids, their languages and the lowest cosine each accepts."""

    idf: np.ndarray
    centres: np.ndarray
    languages: list[str]
    floors: np.ndarray

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine from 0 to 1, rejected) of each text."""
        names, scores, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for i, text in enumerate(texts):
            if not has_letter(text):
                names.append(UNKNOWN)
                continue
            if not self.languages:
                names.append(UNKNOWN)
                continue
            counts = ngram_counts(text)
            cosines = self.centres @ unit(term_frequencies(counts) * self.idf)
            best = int(cosines.argmax())
            names.append(self.languages[best])
            scores[i] = min(max(float(cosines[best]), 0.0), 1.0)
            grams = np.count_nonzero(counts)
            rejected[i] = scores[i] < self.floors[best] * grams / (grams + SHORT)
        return names, scores, rejected


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out first centres; (centres, labels)."""
    picked, nearest = [0], x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    centres, labels = x[picked], None
    for _ in range(rounds):
        labels = (x @ centres.T).argmax(1)
        centres = np.stack([unit(x[labels == j].sum(0)) if (labels == j).any() else centres[j] for j in range(len(centres))])
    return centres, (x @ centres.T).argmax(1)


def fit(labelled: DataFrame, sample: int = 1000, languages: int | None = None, most: int = 12_000, clusters: int = 6, slack: float = 0.5) -> Centroids:
    """Fit on rows of ``labelled`` (text and lang).

    Rows without a label or a letter do not count. Of each language (of the ``languages``
    with the most texts, if that is given) up to ``sample`` texts are taken, and ``most`` of
    all together, but one of each language at least: those with the smallest hash. Equal
    texts of a language are one, however often they occur. A centroid accepts what has at
    least ``slack`` times the smallest cosine that it has with its own rows. Without rows,
    everything is ``und``. The driver gets a vector of DIMENSIONS half floats for each text
    taken.
    """
    nothing = Centroids(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    # Equal texts are taken once, so they count once too, or a much copied text would use up its language's share.
    keys = stored(rows.select("lang", "h").distinct(), "labelled")
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    counts = (counts if languages is None else counts.limit(languages)).collect()
    if not counts:
        return nothing
    wanted = max(1, min(sample, most // len(counts)))

    def within(df: DataFrame, limits: dict) -> DataFrame:
        """Rows of a hash, without its lowest bit, up to the limit of their language."""
        of = labelled.sparkSession.createDataFrame(list(limits.items()), "lang string, _limit long")
        return df.join(F.broadcast(of), "lang").where(F.shiftrightunsigned("h", 1) <= F.col("_limit")).drop("_limit")

    # Hashes are even, so a share of them gives a sample of a known size without a sort. Some
    # more than wanted are looked at, and more again of a language that has too few of them.
    share = wanted + 8 * wanted**0.5 + 32
    open_limits, least = {r.lang: min(int(2**63 * (share / r.n)), 2**63 - 1) for r in counts}, {}
    while open_limits:
        hashes = defaultdict(list)
        for r in within(keys, open_limits).collect():
            hashes[r.lang].append((r.h & (1 << 64) - 1) >> 1)
        again = {}
        for r in counts:
            if r.lang in open_limits:
                own, limit = sorted(hashes[r.lang]), open_limits[r.lang]
                if len(own) < min(wanted, r.n) and limit < 2**63 - 1:
                    again[r.lang] = min(2 * limit + 1, 2**63 - 1)
                else:
                    least[r.lang] = own[min(wanted, r.n) - 1]
        open_limits = again

    @F.arrow_udf("binary")
    def vector(texts: pa.Array) -> pa.Array:
        return pa.array([term_frequencies(ngram_counts(t)).astype(np.float16).tobytes() for some in in_slices(texts) for t in some], pa.binary())

    # Equal texts come together before their vectors are made.
    got = within(rows, least).dropDuplicates(["lang", "h"]).select("lang", "h", vector("text").alias("v")).toArrow()
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    order = np.lexsort((got.column("h").to_numpy().view(np.uint64), langs.astype(str)))
    rank = np.arange(len(order)) - np.searchsorted(langs[order].astype(str), langs[order].astype(str))
    order = order[rank < wanted]
    langs = langs[order]
    # One matrix, filled and weighted in place: the driver holds the vectors once, and half floats as they came.
    x, vectors = np.empty((len(order), DIMENSIONS), np.float32), got.column("v").combine_chunks()
    for i, at in enumerate(order.tolist()):
        x[i] = np.frombuffer(vectors[at].as_buffer(), np.float16)
    del got, vectors
    # A slot in all rows of all languages says nothing; a rare one says most.
    idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 0.1).astype(np.float32)
    x *= idf
    for i in range(0, len(x), 1000):
        x[i : i + 1000] = unit(x[i : i + 1000])
    centres, names, floors = [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        found, labels = _k_means(own, clusters)
        for j in range(len(found)):
            mine = own[labels == j]
            if len(mine):
                centres.append(found[j])
                names.append(lang)
                floors.append(slack * float((mine @ found[j]).min()))
    return Centroids(idf, np.stack(centres).astype(np.float32), names, np.array(floors))


def with_language(docs: DataFrame, model: Centroids) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``, from ``text`` alone, to every row.

    A text that is null or has no letter is ``und``, of score 0, and rejected. Columns that
    have one of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats a centroid, clusters * languages of them

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pa.Array) -> pa.Array:
        names, scores, rejected = [], [], []
        for some in in_slices(texts):
            for whole, part in zip((names, scores, rejected), shared.value.predict(some), strict=True):
                whole.extend(part)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(*rest, of("text").alias("_said")).select(*rest, "_said.lang_pred", "_said.score", "_said.rejected")


def held_out(folds: int = 5, fold: int = 0) -> Column:
    """Rows whose crc32 of doc_id has the given remainder; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of ``docs``.

    The classifier learns from the rows that are not held out; repeated rows are each
    predicted, other columns are left out, and an empty table gives no row.
    """
    model = fit(docs.where(~held_out()).select("text", "lang"), **options)
    return with_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
