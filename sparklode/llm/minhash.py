"""b-bit MinHash near-duplicates: bands of minima give candidates, packed low bits an estimate, full sets the link.

Documents with equal shingle sets are folded first. In each bucket members meet a hub, never each other; links make
components, and only buckets whose members are still in several components are looked at again: with other
hubs, and in the end the members outside a bucket's main component against that bucket. So a large group of
copies costs its size, and pairs that could not join two components are not made.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.llm.common import Roller, Scratch, chunks, digests, keyed_texts, mix64

#: Minima of a signature; low bits of each that are kept, PER_LONG to a 64-bit number. The first BANDS * ROWS make the bands,
#: and a first estimate that is cheap.
MINIMA, BITS, BANDS, ROWS = 1024, 4, 32, 4
PER_LONG = 64 // BITS
LONGS, COARSE = MINIMA // PER_LONG, BANDS * ROWS

#: A candidate goes on to the full sets if its estimate is at most this many standard deviations below the threshold.
SIGMAS = 5.0

#: Times that buckets of several components get other hubs before the rest is compared member by member.
HUB_ROUNDS = 1

_FACTORS = np.random.default_rng(404).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTES = bytes(c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))


#: Words whose numbers a worker keeps (the store is emptied when it is full), and shingles of hubs that it keeps while it compares.
CACHED_WORDS, KEPT_SHINGLES = 400_000, 200_000


class _Numbers(dict):
    """A 64-bit number of each word, from a digest of its bytes."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return n


def shingle_set(text: bytes, words: int) -> set[bytes]:
    """A text's distinct shingles themselves: the words of each, joined by one space."""
    w = text.translate(_LOWER_BYTES).split()
    if len(w) <= words:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)))


class Shingler:
    """Distinct word shingles as 64-bit hashes, made of the words' numbers."""

    def __init__(self, words: int):
        self.words, self.rows, self.numbers = words, Roller(22), _Numbers()

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Document (index) and hash of each distinct shingle, in that order."""
        rows = [t.translate(_LOWER_BYTES).split() for t in texts]
        if len(self.numbers) > CACHED_WORDS:
            self.numbers.clear()
        first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))))
        values = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(rows)), np.uint64, int(first[-1]))
        n = np.diff(first)
        prefix = self.rows.prefix(values)
        width = np.minimum(n, self.words)
        count = np.where(n > 0, n - width + 1, 0)
        doc = np.repeat(np.arange(len(texts)), count)
        begin = np.repeat(first[:-1], count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        hashes = self.rows.spans(prefix, begin, begin + width[doc])
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        return doc[new], hashes[new]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set1 and set2 (digests of the set), sig (packed low bits), bands; the last four null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts):
                doc, h = shingler.sets(texts[lo:hi])
                n = np.bincount(doc, minlength=hi - lo)
                some = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[some]
                minima = np.zeros((hi - lo, MINIMA), np.uint32)
                sets = np.zeros((hi - lo, 2), np.int64)
                if len(some):
                    for i, f in enumerate(_FACTORS):
                        minima[some, i] = np.minimum.reduceat(h * f, begin) >> np.uint64(32)
                    sets[some] = digests(h.tobytes(), 8 * begin, 8 * (begin + n[some]), 16)
                low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(hi - lo, LONGS, PER_LONG)
                sig = np.bitwise_or.reduce(low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=2)
                bands = np.full((hi - lo, BANDS), 0, np.uint64)
                rows = minima[:, :COARSE].reshape(hi - lo, BANDS, ROWS).astype(np.uint64)
                bands += np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for r in range(ROWS):
                    bands = mix64(bands ^ rows[:, :, r])
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(n.astype(np.int64)),
                        pa.array(sets[:, 0], mask=empty),
                        pa.array(sets[:, 1], mask=empty),
                        pa.array([None if e else x for e, x in zip(empty, sig.view(np.int64).tolist(), strict=True)], pa.list_(pa.int64())),
                        pa.array([None if e else x for e, x in zip(empty, bands.view(np.int64).tolist(), strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set1", "set2", "sig", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set1 long, set2 long, sig array<long>, bands array<long>")


def _differing(x: Column, y: Column) -> Column:
    """How many of the minima of two packed numbers differ in their low bits."""
    z = x.bitwiseXOR(y)
    z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
    z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return F.bit_count(z)


def estimates_allow(a: Column, b: Column, threshold: float) -> Column:
    """Whether the similarity, estimated from the share of equal low bits less what chance makes equal, may reach the
    threshold: first by the bands' minima, then by all."""
    coarse, chance = F.lit(0), 2.0**-BITS
    for i in range(COARSE // PER_LONG):
        coarse = coarse + _differing(a[i], b[i])
    every = F.aggregate(F.zip_with(a, b, _differing), F.lit(0), lambda acc, n: acc + n)
    value = lambda differ, n: ((1 - differ / F.lit(float(n))) - chance) / (1 - chance)
    return (value(coarse, COARSE) >= least_estimate(threshold, COARSE)) & (value(every, MINIMA) >= least_estimate(threshold, MINIMA))


def least_estimate(threshold: float, minima: int) -> float:
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * threshold
    return threshold - SIGMAS * (equal * (1 - equal) / minima) ** 0.5 / (1 - chance)


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets of shingles, as words, have den * intersection >= num * union."""
    text = docs.select("doc_id", "text")
    both = pairs.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    # b, the hub, may stand in many pairs: its text comes last, and rows of one hub follow one another
    both = both.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, set[bytes]] = OrderedDict()
        size = 0

        def of(doc: int, text: bytes) -> set[bytes]:
            nonlocal size
            if doc in kept:
                kept.move_to_end(doc)
            else:
                kept[doc] = shingle_set(text, shingle)
                size += len(kept[doc])
                while size > KEPT_SHINGLES and len(kept) > 1:
                    size -= len(kept.popitem(last=False)[1])
            return kept[doc]

        for batch in batches:
            out_a, out_b = [], []
            cols = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()]
            for a, b, ta, tb in zip(*cols, strict=True):
                x, y = shingle_set(ta or b"", shingle), of(b, tb or b"")
                if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
                    continue
                common = len(x & y)
                if den * common >= num * (len(x) + len(y) - common):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp): the smallest id that each id of the links reaches, by alternating large and small stars."""
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{name}-edges")
    step, last = 0, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = scratch.table(small.filter("u != v").distinct(), f"{name}-{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u"), F.expr("sum(cast(u as decimal(38,0)))")).first()
        if step:
            scratch.drop(f"{name}-{step - 1}")
        if now == last:
            break
        step, last = step + 1, now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def near_duplicates(documents: DataFrame, shingle: int = 4, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reached over links), kept (doc_id is that one).

    documents: doc_id, text and other columns, which are left out. Words are runs of bytes other than ASCII white
    space, A-Z lower-cased; a document's set is its distinct shingles of that many words, or all its words as one if
    there are fewer. Two documents are linked if den * intersection >= num * union. A null or empty text has
    an empty set and no links. Rows without doc_id are left out, rows that repeat one count as one
    document (keyed_texts); an empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = keyed_texts(documents, "doc_id", "text")
    rows = scratch.table(signatures(docs, shingle), "signatures")
    folds = rows.filter("set1 is not null").groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = scratch.table(rows.select("doc_id", "n_shingles", "set1", "set2").join(folds, ["set1", "set2", "n_shingles"]).select("doc_id", "rep"), "members")
    # signatures stay where they are; what is joined and dealt out by bucket is the bands alone
    reps = rows.select("doc_id", "bands").join(member.filter("doc_id = rep").select("doc_id"), "doc_id")
    bands = scratch.table(reps.select(F.col("doc_id").alias("id"), "bands"), "bands")
    every = bands.select(F.explode("bands").alias("key"), "id")
    shared = scratch.table(every.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("other"), F.count("*").alias("n")).filter("hub < other").select("key", "hub", "n"), "shared")
    buckets = scratch.table(every.join(shared, "key"), "buckets")

    fits = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & estimates_allow(F.col("sa"), F.col("sb"), num / den)
    one = rows.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    two = rows.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))

    def linked(pairs: DataFrame, name: str, estimated: bool = False) -> DataFrame:
        """Confirmed links of the pairs (a, b). estimated: their estimates were looked at already."""
        near = pairs if estimated else scratch.table(pairs.join(one, "a").join(two, "b").filter(fits).select("a", "b"), f"{name}-near")
        ids = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
        return scratch.table(confirm(near, docs.join(ids, "doc_id", "left_semi"), shingle, num, den), f"{name}-links")

    # the text that others were copied from shares most buckets, so each bucket has its most connected member as a second hub
    degree = buckets.groupBy("id").agg(F.sum("n").alias("degree"))
    centre = buckets.join(degree, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", "id")).alias("centre"))
    by_centre = buckets.join(centre, "key").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    first = buckets.select(F.col("id").alias("a"), F.col("hub").alias("b")).unionByName(by_centre).filter("a != b")
    tried = scratch.table(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs0")
    links = linked(tried, "hub0")
    comps = components(links, scratch, "comp0")
    mixed = buckets.select("key", "id")
    for turn in range(1, HUB_ROUNDS + 2):
        labelled = mixed.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        split = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("key")
        mixed = scratch.table(labelled.join(split, "key"), f"mixed{turn}")
        if turn <= HUB_ROUNDS:
            hubs = mixed.groupBy("key").agg(F.max_by(F.struct("id", "comp"), F.xxhash64("id", F.lit(turn))).alias("h")).select("key", F.col("h.id").alias("b"), F.col("h.comp").alias("cb"))
            pairs = mixed.join(hubs, "key").filter("comp != cb").select(F.col("id").alias("a"), "b")
        else:
            sizes = mixed.groupBy("key", "comp").agg(F.count("*").alias("n"))
            main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
            marked = mixed.join(main, "key").select("key", "id", "comp", F.when(F.col("comp") != F.col("main"), F.col("key")).alias("out"))
            held = marked.groupBy("id").agg(F.min("comp").alias("comp"), F.collect_list("key").alias("keys"), F.collect_list("out").alias("outs"))
            full = held.join(rows.select(F.col("doc_id").alias("id"), "n_shingles", "sig"), "id")
            outside = full.select(F.explode("outs").alias("key"), F.col("id").alias("a"), "comp", F.col("n_shingles").alias("na"), F.col("sig").alias("sa"), F.col("keys").alias("ka"))
            rest = full.select(F.explode("keys").alias("k2"), F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"), F.col("keys").alias("kb"))
            # a pair is made in the least bucket that it shares, and only if its sizes and estimate allow a link
            least = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")
            pairs = outside.join(rest, (F.col("key") == F.col("k2")) & (F.col("comp") != F.col("cb")) & fits & least).select("a", "b")
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, f"pairs{turn}")
        if not pairs.isEmpty():
            tried = tried.unionByName(pairs)
            more = linked(pairs, f"hub{turn}", turn > HUB_ROUNDS)
            if not more.isEmpty():
                links = links.unionByName(more)
                comps = components(links, scratch, f"comp{turn}")
        mixed = mixed.select("key", "id")
    of_rep = member.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(of_rep, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
