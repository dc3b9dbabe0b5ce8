"""Super-k-mers: runs of windows that share a minimizer, the unit in which repeated paths are compacted.

A window is `window` consecutive symbols (words or bytes) of one document. Its minimizer is the leftmost k-mer
with the smallest hash, so equal windows have equal minimizers wherever they stand. Consecutive windows with
the same minimizer occurrence are one segment: a row for some dozen bytes of text in place of a row a window.
Hashes only choose minimizers; digests of the bytes themselves tell segments and windows apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.common import BYTE_VALUES, SPACE_TABLE, Roller, Scratch, chunks, digests, first_min, mix64, quick_digests, word_bounds

#: How a mark's number holds a segment: start << SHIFT | windows.
SHIFT = 8


@dataclass(frozen=True)
class Alphabet:
    """words: symbols are the runs of bytes other than ASCII white space; else they are bytes."""

    words: bool
    window: int
    k: int


class Symbols:
    """The symbols of a chunk of documents: hash values, the documents' first symbols, places in the buffer.
    Words are parted by one space there, so equal sequences of words are equal bytes."""

    def __init__(self, texts: list[bytes], words: bool, bytes_roller: Roller):
        if words:
            texts = [b" ".join(t.split()) for t in texts]
        self.raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(sizes)))
        if words:
            self.starts, self.ends = word_bounds(buf, SPACE_TABLE)
            self.values = bytes_roller.spans(bytes_roller.prefix(BYTE_VALUES[buf]), self.starts, self.ends)
            self.first = np.searchsorted(self.starts, at)
            self.gap = 0
        else:
            self.starts = self.ends = None
            self.values = BYTE_VALUES[buf]
            self.first, self.gap = at, 1  # the newline after each document is none of its bytes
        self.sizes = np.diff(self.first) - self.gap

    def digests(self, lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
        """Digests of the symbols from lo to before hi."""
        if self.starts is None:
            return quick_digests(self.raw, lo, hi, size)
        return digests(self.raw, self.starts[lo], self.ends[hi - 1], size)


class Cutter:
    """Segments of chunks of documents."""

    def __init__(self, alphabet: Alphabet):
        self.alphabet = alphabet
        self.bytes, self.mini = Roller(11), Roller(12)

    def symbols(self, texts: list[bytes]) -> Symbols:
        return Symbols(texts, self.alphabet.words, self.bytes)

    def segments(self, s: Symbols) -> tuple[np.ndarray, ...]:
        """document (index in the chunk), start in it, windows, minimizer, the minimizer's place from the start."""
        a = self.alphabet
        n = len(s.values)
        none = np.zeros(0, np.int64)
        if n < a.window:
            return none, none, none, none.astype(np.uint64), none
        prefix = self.mini.prefix(s.values)
        kmers = self.mini.windows(prefix, a.k)
        at = first_min(kmers, a.window - a.k + 1)
        # windows that stand in one document
        good = np.zeros(n + 1, np.int32)
        counts = np.maximum(s.sizes - a.window + 1, 0)
        lo = s.first[:-1][counts > 0]
        good[lo] += 1
        good[lo + counts[counts > 0]] -= 1
        inside = np.cumsum(good[: len(at)]) > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
        starts = np.flatnonzero(begins)
        order = np.cumsum(begins)[inside]
        width = np.bincount(order, minlength=len(starts) + 1)[1:]
        doc = np.searchsorted(s.first, starts, "right") - 1
        return doc, starts - s.first[doc], width, mix64(kmers[at[starts]]), at[starts] - starts


def utf8(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def segment_rows(docs: DataFrame, alphabet: Alphabet, digest: bool, places: bool = False) -> DataFrame:
    """mini, doc_id, mark (start << SHIFT | windows), again (the minimizer comes more than once in the document) and, if asked for, seg (digest of the segment)
    or place (of the minimizer, from the segment's start)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(alphabet)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            for lo, hi in chunks(texts):
                s = cutter.symbols(texts[lo:hi])
                doc, start, width, mini, place = cutter.segments(s)
                if not len(doc):
                    continue
                order = np.lexsort((mini, doc))
                d, m = doc[order], mini[order]
                same = (d[1:] == d[:-1]) & (m[1:] == m[:-1])
                again = np.zeros(len(doc), bool)
                again[order[1:][same]] = True
                again[order[:-1][same]] = True
                cols = [pa.array(mini.view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array((start << SHIFT) | width), pa.array(again)]
                if digest:
                    first = s.first[doc] + start
                    cols.append(pa.array(s.digests(first, first + width - 1 + alphabet.window, 8)[:, 0]))
                if places:
                    cols.append(pa.array(place, pa.int16()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["mini", "doc_id", "mark", "again"] + ["seg"] * digest + ["place"] * places
    return docs.select("doc_id", "text").mapInArrow(run, "mini long, doc_id long, mark long, again boolean" + (", seg long" if digest else "") + (", place short" if places else ""))


def repeated_segments(docs: DataFrame, alphabet: Alphabet, within: bool, scratch: Scratch) -> DataFrame:
    """doc_id, mark, mini, copies, open and, if within, place: segments of which some window may occur earlier.

    Segments with equal minimizers meet by a partial aggregate and a join, which both stand a hot
    minimizer. Where all of them are equal the path does not branch: every one but the first is a repeat as
    a whole (open false). Where they differ, their windows have to be compared one by one (open true). within:
    a window may also repeat in its own document.
    """
    groups = segment_rows(docs, alphabet, True).groupBy("mini").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("seg").alias("s0"), F.max("seg").alias("s1"), F.count("*").alias("copies"))
    groups = groups.filter("copies > 1" if within else "d0 < d1").select("mini", "d0", F.col("s0").eqNullSafe(F.col("s1")).alias("same"), "copies")
    # a table of its own, so that the join below deals both sides itself and can split a hot minimizer
    groups = scratch.table(groups, "minimizers")
    met = segment_rows(docs, alphabet, False, within).join(groups, "mini")
    opened = ~F.col("same") | (F.col("doc_id") == F.col("d0"))
    wanted = ~F.col("same") | (F.col("doc_id") > F.col("d0")) | (F.lit(within) & F.col("again"))
    return scratch.table(met.filter(wanted).select("doc_id", "mark", "mini", "copies", opened.alias("open"), *["place"] * within), "segments")


def marks_by_doc(segments: DataFrame, name: str) -> DataFrame:
    return segments.groupBy("doc_id").agg(F.collect_list("mark").alias(name))


def covered(sizes: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For the symbols of a chunk, whether one of the spans (document, start in it, length) covers them."""
    total = int(first[-1]) if len(first) else 0
    edge = np.zeros(total + 1, np.int64)
    at = first[doc] + start
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + length, total), -1)
    return np.cumsum(edge[:total]) > 0


def list_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of each element of a list column and the elements; null lists are empty."""
    lengths = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    return np.repeat(np.arange(len(lengths)), lengths), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
