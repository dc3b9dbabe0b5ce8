"""Benchmark decontamination: a prefix-filtered set join in DataFrame functions only.

Shingles of two words are ordered by rarity, by their counts over all documents. A document holds a window of an item only
if it holds the window's rarest shingle, so that one is the window's prefix: documents and items meet on such shingles
alone. The places of both fix how the texts lie to one another; lengths bound what can fit; and the words around
the meeting place are compared one by one, as far as a window can reach. A window of one word is its own shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.llm.common import Scratch, keyed_texts
from sparklode.llm.urlfilter import LOWER, UPPER

#: Rows up to which benchmark shingles or probes are broadcast (about 30 MB); more are joined by shuffle.
BROADCAST_ROWS = 200_000

#: What separates words: ASCII other than digits and letters, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z alone lower-cased. lower() does that for texts without other capitals; translate() is slower."""
    text = F.coalesce(text, F.lit(""))
    cased = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]")
    low = F.when(cased, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shingles_of(words: Column) -> Column:
    """The hash of each word with the next one, of the last word alone."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _placed(docs: DataFrame, singles: bool) -> DataFrame:
    """doc_id, p, h: each document's shingles with their places; singles: each word alone too."""
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    out = words.select("doc_id", F.posexplode(shingles_of(F.col("words"))).alias("p", "h"))
    if singles:
        out = out.unionByName(words.select("doc_id", F.posexplode(F.transform("words", lambda w: F.xxhash64(w))).alias("p", "h")))
    return out


def probes(docs: DataFrame, benchmark: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, bool]:
    """h, need, q_before, around, items: the prefix shingles of the items' windows, the words that a window takes, those before the
    shingle in around, the words around, and the items that have just that; and whether some item is one word.

    Every window has its rarest shingle among them (counts over all documents, ties by the hash, then by place).
    """
    items = scratch.table(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter("item_id is not null and size(words) > 0").distinct(), "items")
    singles = not items.filter("size(words) = 1").isEmpty()
    placed = scratch.table(items.select("item_id", "words", F.posexplode(shingles_of(F.col("words"))).alias("q", "h")), "shingles")
    vocabulary = placed.select("h").distinct()
    n_shingles = placed.count()
    counts = _placed(docs, singles).select("h").join(_small(vocabulary, n_shingles), "h", "left_semi").groupBy("h").agg(F.count("*").alias("df"))
    ranked = placed.join(counts, "h", "left").groupBy("item_id", "words").agg(F.sort_array(F.collect_list(F.struct("q", F.coalesce("df", F.lit(0)).alias("df"), "h"))).alias("places"))
    n = F.size("words")
    need = F.least(F.lit(window), n)
    starts = F.sequence(F.lit(0), n - need)
    rarest = F.array_distinct(F.transform(starts, lambda s: F.array_min(F.transform(F.slice("places", s + 1, F.greatest(need - 1, F.lit(1))), lambda p: F.struct(p["df"], p["h"], p["q"])))))
    at = ranked.select("item_id", "words", need.alias("need"), F.explode(rarest).alias("p"))
    q_before = F.least(F.col("p.q"), F.lit(window - 1))
    around = F.slice("words", F.col("p.q") - q_before + 1, q_before + window)
    at = at.select(F.col("p.h").alias("h"), "need", q_before.alias("q_before"), around.alias("around"), "item_id")
    return scratch.table(at.groupBy("h", "need", "q_before", "around").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "probes"), singles


def hit_spans(documents: DataFrame, probe: DataFrame, singles: bool, window: int, scratch: Scratch) -> DataFrame:
    """doc_id, n_words and hits: array of (start, end, items), the runs of words that windows of items cover."""
    n_probe = probe.count()
    met = _placed(documents, singles).join(_small(probe.select("h").distinct(), n_probe), "h", "left_semi")
    places = met.groupBy("doc_id").agg(F.collect_set(F.struct("p", "h")).alias("places"))
    texts = documents.join(places, "doc_id", "left").select("doc_id", words_of(F.col("text")).alias("words"), "places")
    # words are used twice here, so that they are made once a document and not once a place
    context = texts.select("doc_id", F.size("words").alias("n_words"), F.transform("places", lambda c: F.struct(c["p"].alias("p"), c["h"].alias("h"), F.slice("words", F.greatest(c["p"] - (window - 1), F.lit(0)) + 1, F.lit(2 * window - 1)).alias("near"))).alias("places"))
    context = scratch.table(context, "places")
    pairs = context.select("doc_id", "n_words", F.explode("places").alias("c")).select("doc_id", "n_words", F.col("c.p").alias("p"), F.col("c.h").alias("h"), F.col("c.near").alias("near")).join(_small(probe, n_probe), "h")
    # how far both reach left and right of the meeting word: bounds by place and length come first, then the word itself
    before, q_before = F.least("p", F.lit(window - 1)), F.col("q_before")
    after = F.least(F.least(F.size("near") - before, F.lit(window)) - 1, F.size("around") - q_before - 1)
    left_most = F.least(before, q_before)
    pairs = pairs.filter((F.col("n_words") >= F.col("need")) & (left_most + after + 1 >= F.col("need")) & (F.get("near", before) == F.get("around", q_before)))

    def reach(most: Column, side: int) -> Column:
        steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.get("near", before + side * i) == F.get("around", q_before + side * i)), i).otherwise(acc))

    met_runs = pairs.select("doc_id", "items", "p", "need", reach(left_most, -1).alias("l"), reach(after, 1).alias("r")).filter("l + r + 1 >= need")
    runs = met_runs.select("doc_id", F.struct((F.col("p") - F.col("l")).alias("start"), (F.col("p") + F.col("r")).alias("end"), "items").alias("run")).groupBy("doc_id").agg(F.collect_set("run").alias("hits"))
    return context.select("doc_id", "n_words").join(runs, "doc_id", "left")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated (n_hit > 0 and share * n_hit >= n_words).

    documents: doc_id, text; benchmark: item_id, text; other columns are left out. Words are runs of characters other than
    ASCII separators, A-Z lower-cased; a window is that many consecutive words of an item, or all of a shorter
    item's; a document's word inside an occurrence of a window is hit. Null and empty texts have no words: such an item
    has no window, such a document no hit. Rows without doc_id or item_id are left out; rows that repeat a doc_id
    count as one document (keyed_texts); texts that share an item_id are windows of one item. An empty
    benchmark hits nothing; an empty documents table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "decontaminate")
    docs = keyed_texts(documents, "doc_id", "text")
    probe, singles = probes(docs, benchmark, window, scratch)
    spans = hit_spans(docs, probe, singles, window, scratch)
    places = F.transform("hits", lambda h: F.sequence(h["start"], h["end"]))
    n_hit = F.when(F.col("hits").isNull(), 0).otherwise(F.size(F.array_distinct(F.flatten(places))))
    items = F.when(F.col("hits").isNull(), F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))))
    out = spans.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
