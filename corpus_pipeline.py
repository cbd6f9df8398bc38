"""The corpus pipeline: ``documents`` from raw rows to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) over all rows that the stage before it
kept, calls one operator of ``quayside.llm``, and applies its decision:

1. language ID drops what the classifier rejects;
2. SimHash near-dedup keeps one document of each component, of its smallest doc_id;
3. benchmark decontamination drops contaminated documents;
4. secret scans replace secrets in ``text`` (and keep the document, with n_chars anew);
5. best-fit packing places what is left in bins.

``run`` writes each stage's rows as Parquet in the shared folder and reads them again.
SQL can say neither the classifier nor the fingerprints' trie nor the forest, so there
is no ``ORACLE_SQL``; the tests compare each stage with a plain version on a small table.
Rows with a null doc_id are of one component only with their near copies; of a component
without any id, too, one row stays, that of the smallest hash of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import stored, table
from quayside.llm.langid import fit, held_out, with_language
from quayside.llm.packing import best_fit
from quayside.llm.phrases import contamination, row_name
from quayside.llm.secrets import with_secrets
from quayside.llm.simhash import near_duplicates

ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what has a language that the classifier knows."""
    model = fit(docs.where(~held_out()).select("text", "lang"))
    judged = with_language(docs.select(F.struct(*_columns(docs)).alias("row"), F.col("text")), model)
    return judged.where(~F.col("rejected")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component, that of the smallest doc_id (one of it, if it repeats or is null).

    Fingerprints and components are found without the texts' company; the rows that stay
    are then picked by id and a hash of the text."""
    rows = docs.select(F.struct(*_columns(docs)).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    found = near_duplicates(docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")), keep=("h",), rooted=True)
    heads = found.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    # A component's heads have one id, or none; an id may stand for several components, each of which keeps a row.
    picked = stored(heads.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("h").alias("h"), F.count(F.lit(1)).alias("n")).drop("root"), "heads")
    kept = rows.join(picked, rows["doc_id"].eqNullSafe(picked["doc_id"]) & (rows["h"] == picked["h"]), "left_semi")
    if picked.where("n > 1").limit(1).count():
        # Some ids repeat, or are null: of the rows of an id and text the first in the order of its columns.
        kept = kept.groupBy("doc_id", "h").agg(F.min("row").alias("row"))
    return kept.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents, named by id and text: ids may be null or repeat."""
    judged = contamination(docs, table(spark, sf_dir, "benchmark"), named=True)
    # A table of known size: a short list is sent to the documents, which then stay where they are.
    dirty = stored(judged.where("contaminated").select(F.col("id").alias("_dirty_id"), F.col("h").alias("_dirty_h")).distinct(), "dirty")
    name, h = row_name(docs)
    return docs.join(dirty, (name == dirty["_dirty_id"]) & (h == dirty["_dirty_h"]), "left_anti").select(*_columns(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the text; no document goes."""
    said = with_secrets(docs.select(F.struct(*_columns(docs)).alias("row"), F.col("text")))
    changed = F.size("secrets") > 0
    row = F.col("row").withField("text", F.when(changed, F.col("clean_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(changed, size).otherwise(F.col("row.n_chars")))
    return said.select(row.alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
