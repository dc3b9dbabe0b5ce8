"""Substring dedup on words by De Bruijn compaction.

Edges of the graph are the windows of 13 words, nodes the 12 words that two windows in a row share. Windows that share a
minimizer travel together: where all segments of a minimizer are equal, their path cannot branch inside and stands for all
its edges at once, whichever document it is in. The other edges are laid out one by one; a join by their digests gives
every edge its first document, and how many different edges come before and after it. Edges that follow one
another in a document become one path where the node between them has one way in and one way out. Source
coordinates (document, word) lead back to the texts. Edges are told apart by 128-bit digests of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparklode.llm.common import Scratch, chunks, keyed_texts
from sparklode.llm.superkmer import SHIFT, Alphabet, Cutter, covered, list_offsets, marks_by_doc, repeated_segments, utf8

#: Words of a k-mer by which windows meet.
MINIMIZER_WORDS = 6


def _open_edges(docs: DataFrame, marks: DataFrame, alphabet: Alphabet) -> DataFrame:
    """one, two (digest), doc_id, at (word), before and after (first half of the neighbouring edges' digests, 0 for none) of every window of the open segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(alphabet)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            row, mark = list_offsets(batch.column(2))
            for lo, hi in chunks(texts):
                mine = (row >= lo) & (row < hi)
                doc, start, width = row[mine] - lo, mark[mine] >> SHIFT, mark[mine] & ((1 << SHIFT) - 1)
                if not len(doc):
                    continue
                s = cutter.symbols(texts[lo:hi])
                order = np.lexsort((start, doc))
                doc, start, width = doc[order], start[order], width[order]
                at = np.repeat(start, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                doc = np.repeat(doc, width)
                place = s.first[doc] + at
                edge = s.digests(place, place + alphabet.window, 16)
                one, before, after = edge[:, 0], np.zeros(len(edge), np.int64), np.zeros(len(edge), np.int64)
                follows = (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + 1)
                before[1:][follows], after[:-1][follows] = one[:-1][follows], one[1:][follows]
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(edge[:, 1]), pa.array(ids[lo:hi][doc]), pa.array(at), pa.array(before), pa.array(after)], ["one", "two", "doc_id", "at", "before", "after"])

    return docs.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(run, "one long, two long, doc_id long, at long, before long, after long")


def _paths(hits: DataFrame) -> DataFrame:
    """doc_id, mark: hits (doc_id, at, way_in, way_out: the edge has one edge before it, one after it) as the paths they make up."""
    in_doc = W.Window.partitionBy("doc_id").orderBy("at")
    joined = (F.col("at") == F.lag("at").over(in_doc) + 1) & F.col("way_in") & F.lag("way_out").over(in_doc)
    number = F.sum(F.when(joined, 0).otherwise(1)).over(in_doc)
    # a mark counts fewer than 1 << SHIFT windows, so a longer path is cut where its place in the document is a multiple of that
    block = F.floor(F.col("at") / ((1 << SHIFT) - 1))
    rows = hits.withColumn("path", number).groupBy("doc_id", "path", block.alias("block")).agg(F.min("at").alias("at"), F.count("*").alias("n"))
    return rows.select("doc_id", (F.shiftleft("at", SHIFT) + F.col("n")).alias("mark"))


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = 13) -> DataFrame:
    """doc_id, mark (first word << SHIFT | windows): windows of documents that also start in a document of a smaller doc_id.

    docs: doc_id, text, unique ids. Spans of a document may overlap.
    """
    alphabet = Alphabet(True, window, MINIMIZER_WORDS if window > MINIMIZER_WORDS else 1)
    segments = repeated_segments(docs, alphabet, False, scratch)
    edges = scratch.table(_open_edges(docs, marks_by_doc(segments.filter("open"), "marks"), alphabet), "edges")
    ways = [f(c).alias(f"{c}_{f.__name__}") for c in ("before", "after") for f in (F.min, F.max)]
    first = edges.groupBy("one", "two").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), *ways).filter("d0 < d1")
    first = first.select("one", "two", "d0", F.expr("before_min = before_max").alias("way_in"), F.expr("after_min = after_max").alias("way_out"))
    first = scratch.table(first, "repeated-edges")  # again so that the join can split a hot edge
    hits = edges.select("one", "two", "doc_id", "at").join(first, ["one", "two"]).filter("doc_id > d0").select("doc_id", "at", "way_in", "way_out")
    return segments.filter("not open").select("doc_id", "mark").unionByName(_paths(hits))


def cut_texts(docs: DataFrame, spans: DataFrame, window: int, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, text: the kept words joined by one space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            row, mark = list_offsets(batch.column(2))
            order = np.argsort(row, kind="stable")
            row, start, width = row[order], (mark >> SHIFT)[order], (mark & ((1 << SHIFT) - 1))[order]
            bound = np.searchsorted(row, np.arange(len(texts) + 1))
            words_n, removed_n, digests, kept_texts = [], [], [], []
            for i, text in enumerate(texts):
                words = text.split()
                a, b = bound[i], bound[i + 1]
                n = len(words)
                if a < b:
                    gone = covered(np.array([n]), np.array([0, n]), np.zeros(b - a, np.int64), start[a:b], width[a:b] - 1 + window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(words)
                words_n.append(n)
                removed_n.append(n - len(words))
                digests.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept_texts.append(joined.decode("utf-8", "replace") if a < b else text.decode("utf-8", "replace"))
            cols = [batch.column(0), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array(kept_texts, pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    joined = docs.join(marks_by_doc(spans, "marks"), "doc_id", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if keep_text else ""))


def dedup_substrings(documents: DataFrame, window: int = 13, keep_text: bool = False) -> DataFrame:
    """Removes each word covered by a window of words that also starts in a document with a smaller doc_id.

    documents: doc_id, text and other columns, which are left out. Words are runs of bytes other than ASCII
    white space, unchanged; windows are judged on the input. Returns doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space) and, with keep_text, that text (a document that loses nothing keeps its text
    as it is). A null or empty text has no words. Rows without doc_id are left out, rows that repeat a doc_id
    count as one document (keyed_texts); an empty table gives no rows. A window repeated only within one document stays.
    """
    scratch = Scratch(documents.sparkSession, "substrings")
    docs = keyed_texts(documents, "doc_id", "text")
    spans = scratch.table(repeated_spans(docs, scratch, window), "spans")
    for name in ("edges", "segments", "minimizers", "repeated-edges"):
        scratch.drop(name)
    return cut_texts(docs, spans, window, keep_text)
