"""Quotes found inside texts.

Quotes of at most ``MOST_ANCHORS`` different texts and ``MOST_BYTES`` go to every
task, which looks for all of them in one pass over its texts (:mod:`scan`): texts
are read once and neither shuffled nor written, only what is found is.

More quotes meet the texts by blocks, on words that a containing text has whole.
A quote's inner words stand whole in a text that contains it. A quote of five
words or more has as its block one window of three inner words, one of three or
four words a single inner word: the one that the fewest quotes share. Texts meet
the blocks by equality of hashes, by a broadcast of the blocks' hashes while
these are at most ``MOST_ANCHORS``, so that texts' words are not shuffled, else by
a join; only what meets is searched for the quote.

Quotes of one or two words have no inner word, but their longer word lies inside
some word of the text (a quote of white space inside a run of it). So they are
looked up in the vocabulary, each distinct word or run once: by their rarest
three characters, or whole where they have fewer, then by containment. Texts
with such a word are searched for the quote.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corrobora.functions.quotes import comparable
from corrobora.operators.scan import Quotes, scan
from corrobora.sources.shared import materialize

#: Quotes, or rows of blocks (hashes, or words with their quotes), that may be broadcast; characters of a block of a short quote.
MOST_ANCHORS, GRAM = 1_000_000, 3
#: Bytes of quotes that may be broadcast.
MOST_BYTES = 16 << 20
_SPACES = r" \t\n\r\f\u000B"


def _words(c: Column) -> Column:
    return F.filter(F.split(c, f"[{_SPACES}]+", -1), lambda w: w != "")


def _runs(c: Column) -> Column:
    return F.filter(F.split(c, f"[^{_SPACES}]+", -1), lambda w: w != "")


def _grams(rows: DataFrame, text: str, k: int) -> DataFrame:
    """``rows`` with ``gram``, the distinct runs of k characters of a column, one a row."""
    cut = rows.withColumn("chars", F.explode(F.array(F.split(text, ""))))  # cut once, not for every run
    made = F.transform(F.sequence(F.lit(1), F.size("chars") - k + 1), lambda i: F.concat(*(F.get("chars", i - 1 + j) for j in range(k))))
    return cut.where(F.size("chars") >= k).withColumn("gram", F.explode(F.array_distinct(made))).drop("chars")


def _holding(words: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, token) for the words that contain a needle; both tables have no repeated rows."""
    length = F.char_length("needle")
    found = None
    for k in range(1, GRAM + 1):
        grams, own = _grams(words, "token", k), needles.where(length == k if k < GRAM else length >= k)
        if own.isEmpty():
            continue
        if k < GRAM:
            met = grams.join(own, F.col("gram") == F.col("needle")).select("needle", "token")
        else:
            parts = _grams(own, "needle", k)
            counts = grams.join(parts.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
            rare = Window.partitionBy("needle").orderBy("n", "gram")
            anchors = parts.join(counts, "gram").withColumn("rank", F.row_number().over(rare)).where("rank = 1").select("gram", "needle")
            met = grams.join(anchors, "gram").where(F.contains("token", "needle")).select("needle", "token")
        found = met if found is None else found.union(met)
    return found


def _met_short(texts: DataFrame, short: DataFrame) -> DataFrame:
    """(doc_id, item_id) of texts that have a word, or run of white space, around the longer word of a quote."""
    word = lambda i: F.get("w", F.lit(i))
    longer = F.when(F.size("w") == 0, F.col("quote")).when((F.size("w") == 1) | (F.char_length(word(0)) >= F.char_length(word(1))), word(0)).otherwise(word(1))
    wanted = materialize(short.select("item_id", longer.alias("needle")), "needles")
    have = texts.select("doc_id", F.explode(F.array_distinct(F.concat(_words(F.col("text")), _runs(F.col("text"))))).alias("token"))
    words = materialize(have.select("token").distinct(), "vocabulary")
    holding = materialize(_holding(words, wanted.select("needle").distinct()).join(wanted, "needle").select("token", "item_id").distinct(), "holding")
    return have.join(F.broadcast(holding) if holding.count() <= MOST_ANCHORS else holding, "token").select("doc_id", "item_id").distinct()


def _windows(words: Column, k: int) -> Column:
    n = F.size(words)
    made = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(*(F.get(words, i - 1 + j) for j in range(k))))
    return F.when(n >= k, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))


def _met(texts: DataFrame, inner: DataFrame, k: int) -> DataFrame:
    """(doc_id, item_id) of texts that have the quote's rarest window of k inner words."""
    blocks = inner.select("item_id", F.explode(_windows(F.col("w"), k)).alias("block"))
    shared = blocks.groupBy("block").agg(F.count_distinct("item_id").alias("shared"))
    rare = Window.partitionBy("item_id").orderBy("shared", "block")
    anchors = blocks.join(shared, "block").withColumn("k", F.row_number().over(rare)).where("k = 1").select("item_id", "block")
    n = anchors.count()
    if not n:
        return texts.select("doc_id").join(anchors.select("item_id"), F.lit(False))
    # the words are a column of their own: inside a lambda they would be cut anew for every window
    words = texts.select("doc_id", F.explode(F.array(_words(F.col("text")))).alias("w"))
    have = words.select("doc_id", F.explode(_windows(F.col("w"), k)).alias("block"))
    return have.join(F.broadcast(anchors) if n <= MOST_ANCHORS else anchors, "block").select("doc_id", "item_id").distinct()


def _scanned(texts: DataFrame, quotes: DataFrame, different: DataFrame) -> DataFrame:
    """(doc_id, item_id) by one pass over the texts for all quotes; ``different``: number, quote, each quote once."""
    rows = different.select("number", F.col("quote").cast("binary").alias("quote")).toArrow()  # at most MOST_ANCHORS rows and MOST_BYTES
    known = texts.sparkSession.sparkContext.broadcast(Quotes(rows.column("quote").to_pylist(), rows.column("number").to_pylist()))
    found = texts.mapInArrow(partial(scan, quotes=known), StructType([texts.schema["doc_id"], StructField("number", LongType())]))
    items = quotes.join(different, "quote").select("number", "item_id")
    return found.join(F.broadcast(items) if items.count() <= MOST_ANCHORS else items, "number").select("doc_id", "item_id").distinct()


def _blocked(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id) of any number of quotes, by blocks."""
    cut = quotes.select("item_id", "quote", F.explode(F.array(_words(F.col("quote")))).alias("w"))
    inner = cut.where(F.size("w") >= 3).select("item_id", "quote", F.explode(F.array(F.slice("w", F.lit(2), F.size("w") - 2))).alias("w"))
    met = _met(texts, inner.where(F.size("w") >= 3), 3).union(_met(texts, inner.where(F.size("w") < 3), 1))
    short = cut.where(F.size("w") < 3)
    if not short.isEmpty():
        met = met.union(_met_short(texts, short))
    return met.join(quotes, "item_id").join(texts, "doc_id").where(F.contains("text", "quote")).select("doc_id", "item_id").distinct()


def _containing(texts: DataFrame, quotes: DataFrame, made: bool) -> DataFrame:
    """``made``: texts are computed, so that they are written where they are read more than once."""
    texts = texts.select("doc_id", "text")
    quotes = materialize(quotes.where(F.length("quote") > 0).select("item_id", "quote"), "quotes")
    different = materialize(quotes.select("quote").distinct().withColumn("number", F.monotonically_increasing_id()), "different")
    n, size = different.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("quote")), F.lit(0))).first()
    if n <= MOST_ANCHORS and size <= MOST_BYTES:
        return _scanned(texts, quotes, different)
    return _blocked(materialize(texts, "texts") if made else texts, quotes)


def containing(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the text contains the quote. texts: doc_id, text; quotes: item_id, quote."""
    return _containing(texts, quotes, made=False)


def containing_normalized(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """The same for texts and quotes in the form in which quotes are compared: entities, quotation marks, dashes, spaces and case do not matter."""
    return _containing(texts.select("doc_id", comparable("text").alias("text")), quotes.select("item_id", comparable("quote").alias("quote")), made=True)
