"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

1. Texts become word lists, once, in a table; the words of the queried phrases are counted
   over all documents.
2. Each phrase is looked up by its ``rare`` rarest words. The index holds the postings
   (word, document, position) of those words, a row each, written to the shared folder.
3. A posting at position p of a word at offset o of a phrase votes for the phrase to start
   at p - o. Starts with a vote of every looked-up word are the intersection of the
   offset-adjusted lists; votes are counted by (phrase, document, start), so a frequent
   word or document is spread over as many keys as it has positions.
4. What is left is compared with the words of the documents that have any, which gives
   exact matches; with a ``slop``, a document matches where all words of a phrase stand near
   its rarest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: What stands between words: every ASCII character but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_ID = -(1 << 63)


def words_of(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z; an empty list for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows(items: DataFrame, size: int = 13) -> tuple[DataFrame, DataFrame]:
    """The distinct phrases (phrase, words) of ``items`` (item_id, text), and (phrase, item_id).

    A phrase is ``size`` consecutive words; an item of fewer, but not none, is one phrase.
    Items with a null id or no word have none.
    """
    words = items.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))))
    cut = words.select("item_id", "w", starts.alias("at")).select("item_id", F.slice("w", F.col("at") + 1, size).alias("words"))
    cut = cut.withColumn("phrase", F.concat_ws(" ", "words")).distinct()
    return cut.select("phrase", "words").distinct(), cut.select("phrase", "item_id")


def _few(words: DataFrame, most: int = 100_000) -> DataFrame | None:
    """The stored list of words to be sent to every task, if it is short enough for that."""
    return F.broadcast(words) if words.count() <= most else None


def row_name(docs: DataFrame) -> tuple[Column, Column]:
    """(id, h) of a row of ``docs`` (doc_id, text): a number in the place of a null id, and the text's hash."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def phrase_matches(docs: DataFrame, phrases: DataFrame, rare: int = 2, slop: int | None = None) -> DataFrame:
    """doc_id, id, h, n_words, found for every row of ``docs`` (doc_id, text).

    found lists (phrase, start, length), null or empty if there is none. ``phrases`` has
    phrase and words. With ``slop`` None the words of a phrase must follow each other. Else
    each must stand within ``slop`` words of an occurrence of the phrase's rarest word, in
    any order, and start is the position of that word (length 1). (id, h) names rows of
    equal id and text, which get equal results.
    """
    name, h = row_name(docs)
    texts = stored(docs.select("doc_id", name.alias("id"), h.alias("h"), words_of(docs["text"]).alias("w")).withColumn("n_words", F.size("w").cast("long")), "words")
    terms = phrases.select("phrase", F.posexplode("words").alias("off", "word"))
    wanted = stored(terms.select("word").distinct(), "wanted")
    said = texts.select(F.explode("w").alias("word"))
    few = _few(wanted)
    # A list that is too long to be sent is met by one row a word and task, not by every word.
    counts = (said.join(few, "word", "left_semi") if few is not None else said).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # Counts are no more than the wanted words, so they are sent where those were.
    counts = F.broadcast(counts) if few is not None else counts.join(wanted, "word", "left_semi")
    # A phrase with a word that occurs nowhere has no match.
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "word")))
    ranked = terms.join(counts, "word", "left").groupBy("phrase").agg(order.alias("terms")).where(F.col("terms")[0]["n"] > 0)
    several = 1 if slop is not None else rare
    lookups = ranked.select("phrase", F.posexplode(F.slice("terms", 1, several)).alias("nth", "t")).select("phrase", F.col("t.off").alias("off"), F.col("t.word").alias("word"))
    lookups = stored(lookups, "lookups")
    needed = lookups.groupBy("phrase").agg(F.count(F.lit(1)).alias("needed"))

    indexed = stored(lookups.select("word").distinct(), "indexed")
    few = _few(indexed)
    postings = texts.select("id", "h", F.posexplode("w").alias("pos", "word"))
    index = stored(postings.join(indexed if few is None else few, "word", "left_semi"), "postings")
    start = F.col("pos") if slop is not None else F.col("pos") - F.col("off")
    votes = index.join(lookups, "word").select("phrase", "id", "h", start.alias("start"), "off").where("start >= 0")
    # The postings of equal rows are votes for one start.
    agreed = votes.groupBy("phrase", "id", "h", "start").agg(F.size(F.collect_set("off")).alias("votes")).join(needed, "phrase").where("votes = needed")
    # A document has each phrase's words once, however often it occurs there.
    places = agreed.groupBy("id", "h", "phrase").agg(F.collect_list("start").alias("starts"))
    candidates = places.join(phrases, "phrase").groupBy("id", "h").agg(F.collect_list(F.struct("starts", "phrase", "words")).alias("c"))
    if slop is None:
        holds = lambda c, at: F.slice("w", at + 1, F.size(c["words"])) == c["words"]
        length = lambda c: F.size(c["words"])
    else:
        low = lambda at: F.greatest(at - slop, F.lit(0))
        holds = lambda c, at: F.size(F.array_except(c["words"], F.slice("w", low(at) + 1, at + slop + 1 - low(at)))) == 0
        length = lambda c: F.lit(1)
    span = lambda c: F.transform(F.filter(c["starts"], lambda at: holds(c, at)), lambda at: F.struct(c["phrase"].alias("phrase"), at.alias("start"), length(c).alias("length")))
    # Only documents with a candidate are read again; equal rows of them are compared once.
    candidates = stored(candidates, "candidates")
    names = candidates.select("id", "h")
    few = _few(names, 1_000_000)
    read = texts.select("id", "h", "w").join(names if few is None else few, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    found = read.join(candidates, ["id", "h"]).select("id", "h", F.flatten(F.transform("c", span)).alias("found")).where(F.size("found") > 0)
    return texts.select("doc_id", "id", "h", "n_words").join(found, ["id", "h"], "left")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, rare: int = 2, named: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``,
    and, if ``named``, the (id, h) of :func:`row_name`, which tells rows of one doc_id apart.

    A word inside an occurrence of a benchmark window is hit; a document is contaminated
    if it has a hit and ``share`` times its hits are at least its words. Null, empty and
    wordless texts have no words and no hits. Rows with equal id and text get equal
    results. Benchmark items that repeat count once, those with a null id not at all.
    Empty tables: no documents, no rows; no items, no hits.
    """
    phrases, members = windows(benchmark, size)
    phrases, members = stored(phrases, "phrases"), stored(members, "members")
    hit = F.size(F.array_distinct(F.flatten(F.transform("found", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    heard = F.array_distinct(F.transform("found", lambda s: s["phrase"]))
    rows = stored(phrase_matches(docs, phrases, rare).select("doc_id", "id", "h", "n_words", F.when(F.size("found") > 0, hit).alias("hit"), F.when(F.size("found") > 0, heard).alias("heard")), "found")
    items = rows.select("id", "h", F.explode("heard").alias("phrase")).join(members, "phrase")
    marks = items.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    n_hit, listed = F.coalesce("hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(marks, ["id", "h"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        *(["id", "h"] if named else []),
    )
