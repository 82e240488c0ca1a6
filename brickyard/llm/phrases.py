"""Exact phrases and proximity through a stored positional inverted index (SQL functions only).

``build_index`` writes the postings (word, document, position) of the words that the test
phrases use, one pass over whole texts. A phrase starts from its rarest word's list; each
further list is shifted by its word's offset and intersected, the second rarest first, the
rest at once for the documents still in play. Posting counts over all documents decide what
is rare. Look-up sides are broadcast only after their rows were counted; above the bound the
same join is shuffled.

Defined results: null or wordless texts have no words and no hits; an item without words has
no windows. Rows that repeat a doc_id with another text are separate documents, rows that
repeat both share their result. Null doc_ids are kept apart by their texts; a null item_id
is written as the empty string.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import fresh, stage

WINDOW = 10
BROADCAST_ROWS = 100_000  # of the short rows counted before each hinted join
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["doc", "seal"]


def words(text: Column) -> Column:
    """Array of words: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(t.rlike(r"[^\x00-\x7F]"),
                 F.translate(t, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(t))
    return F.array_remove(F.split(low, BREAKS), "")


def _small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written stage) with a broadcast hint if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.count() <= bound else df


def windows(items: DataFrame, id_col: str, text_col: str, width: int = WINDOW
            ) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words, len) and which item has which (wid, item)."""
    w = F.col("w")
    cut = F.when(F.size(w) >= width,
                 F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)),
                             lambda i: F.slice(w, i, width))).otherwise(F.array(w))
    rows = (items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                         words(F.col(text_col)).alias("w"))
            .filter(F.size("w") > 0).select("item", F.explode(cut).alias("words")))
    each = stage(rows.distinct(), "phrase-windows")
    named = stage(each.select("words").distinct()
                  .select(F.monotonically_increasing_id().alias("wid"), "words",
                          F.size("words").alias("len")), "phrase-names")
    return named, stage(each.join(named, "words").select("wid", "item"), "phrase-items")


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Written postings (doc_id, seal, n_words, pos, word) of the vocabulary's words.

    Each document also has one posting of the empty word at position 0, which carries its
    number of words. ``seal`` is a hash of id and text that tells rows with one id apart.
    """
    vocab = stage(vocabulary.select("word").union(
        docs.sparkSession.range(1).select(F.lit("").alias("word"))).distinct(), "phrase-vocab")
    rows = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.xxhash64(F.col(id_col).cast("bigint"), text_col).alias("seal"),
                        F.concat(F.array(F.lit("")), words(F.col(text_col))).alias("w"))
            .select("doc_id", "seal", (F.size("w") - 1).cast("bigint").alias("n_words"),
                    F.posexplode("w").alias("pos", "word")))
    return stage(rows.join(_small(vocab), "word"), "phrase-postings")


def _keyed(index: DataFrame) -> DataFrame:
    return index.withColumn("doc", F.coalesce("doc_id", F.lit(-1)))


def _ranked(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(wid, len, off, word, rank): a phrase's words, rarest first by all documents' counts."""
    from pyspark.sql import Window

    count = index.groupBy("word").agg(F.count("*").alias("n"))
    terms = phrases.select("wid", "len", F.posexplode("words").alias("off", "word"))
    order = Window.partitionBy("wid").orderBy("n", "off")
    return stage(terms.join(count, "word").withColumn("rank", F.row_number().over(order)),
                 "phrase-terms")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc, seal, start, wid, len): every exact occurrence of every phrase, 1-based starts."""
    posts = _keyed(index).drop("doc_id")
    terms = _ranked(phrases, index)

    def rank(r: int, *columns: str) -> DataFrame:
        return terms.filter(F.col("rank") == r).select("wid", *columns, "word", "off")

    first = (posts.join(_small(rank(1, "len")), "word")
             .select(*KEY, (F.col("pos") - F.col("off")).alias("start"), "wid", "len", "n_words")
             .filter("start >= 1 AND start + len - 1 <= n_words").drop("n_words").distinct())
    first = stage(first, "phrase-first")
    # Second rarest: its list, shifted by its offset, against the first.
    second = rank(2)
    some = _small(second.select("word").distinct())
    lists = posts.join(some, "word", "left_semi").select(*KEY, "pos", "word")
    due = (first.join(_small(second), "wid")
           .withColumn("pos", F.col("start") + F.col("off")).drop("off"))
    both = stage(due.join(lists, [*KEY, "pos", "word"], "left_semi")
                 .select(*KEY, "start", "wid", "len")
                 .union(first.filter("len = 1").select(*KEY, "start", "wid", "len")),
                 "phrase-second")
    # The other words, in the documents that are left.
    docs = _small(stage(both.select(*KEY).distinct(), "phrase-docs"))
    rest = _small(terms.filter("rank > 2").select("wid", "word", "off"))
    due = both.join(rest, "wid").withColumn("pos", F.col("start") + F.col("off"))
    lists = (posts.filter("word <> ''").join(docs, KEY, "left_semi").select(*KEY, "pos", "word")
             .distinct())
    found = (due.join(lists, [*KEY, "pos", "word"])
             .groupBy(*KEY, "start", "wid", "len").agg(F.count("*").alias("n"))
             .filter("n = len - 2").drop("n"))
    return found.union(both.filter("len <= 2"))


def proximity_matches(index: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """(doc, seal, wid, pos): places of a phrase's rarest word with all its words within ``span``.

    A word stands within ``span`` when its distance to the rarest word is at most that; the
    lists are joined on cells of ``span`` positions, so a common word meets near places only.
    """
    posts = _keyed(index).drop("doc_id")
    terms = _ranked(phrases, index)
    first = (posts.join(terms.filter("rank = 1").select("wid", "len", "word"), "word")
             .select(*KEY, "wid", F.col("pos").alias("at")).distinct())
    want = phrases.select("wid", F.size(F.array_distinct("words")).alias("need"))  # absent words too
    cell = F.floor(F.col("at") / span)
    near = (first.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
            .join(terms.select("wid", "word").distinct(), "wid"))
    lists = posts.select(*KEY, "word", "pos", F.floor(F.col("pos") / span).alias("cell"))
    return (near.join(lists, [*KEY, "word", "cell"]).filter(F.abs(F.col("pos") - F.col("at")) <= span)
            .groupBy(*KEY, "wid", "at").agg(F.count_distinct("word").alias("got"))
            .join(want, "wid").filter("got = need")
            .select(*KEY, "wid", F.col("at").alias("pos")))


def hits(matches: DataFrame) -> DataFrame:
    """(doc, seal, n_hit): words inside at least one match."""
    from pyspark.sql import Window

    order = Window.partitionBy(*KEY).orderBy("start")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0))
    return (matches.groupBy(*KEY, "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
            .withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach)))
            .groupBy(*KEY).agg(F.sum("new").cast("bigint").alias("n_hit")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per document with ``seal``: n_words, n_hit, n_items, items_sha256, contaminated."""
    phrases, members = windows(items, item_col, item_text_col, width)
    index = build_index(docs, phrases.select(F.explode("words").alias("word")), id_col, text_col)
    found = stage(phrase_matches(index, phrases), "phrase-found")
    names = (found.join(_small(members), "wid").select(*KEY, "item").distinct()
             .groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items")))
    own = hits(found).join(names, KEY)
    count = F.coalesce("n_hit", F.lit(0))
    return (_keyed(index.filter("word = ''")).join(own, KEY, "left")
            .select("doc_id", "n_words", count.alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256)
                    .alias("items_sha256"),
                    (count > 0).alias("contaminated"), "seal"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows; all columns as they are."""
    own, seal, name = (fresh(docs, c) for c in ("_own_seal", "_bad_seal", "_bad_id"))
    bad = stage(contamination(docs, items, id_col, text_col).filter("contaminated")
                .select(F.col("seal").alias(seal), F.col("doc_id").alias(name)).distinct(),
                "phrase-bad")
    rows = docs.withColumn(own, F.xxhash64(F.col(id_col).cast("bigint"), text_col))
    hit = (F.col(own) == F.col(seal)) & F.col(id_col).cast("bigint").eqNullSafe(F.col(name))
    return rows.join(_small(bad), hit, "left_anti").select(docs.columns)
