"""Suffix-array dedup on bytes, with linear-time suffix sorting by grouping.

Texts are parsed at minimizers into segments. A segment whose minimizer occurs nowhere else cannot hold a
repeat; equal segments fold into one entry of a dictionary with its first place; and entries that share a minimizer but differ are
sorted together: their suffix array tells which windows of theirs are equal, and the first place wins. Every window of an
entry holds its minimizer, so the minimizer's bytes, and those beside it that all its entries share, are one letter there.

The suffix array itself comes from grouping: suffixes are grouped by Lyndon prefix, groups are processed in
descending order, where the previous-smaller pointers of a group's suffixes split the lower groups; then one pass in
ascending order emits each group's suffixes. Nothing is renamed and there is no recursion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.common import Scratch, chunks, keyed_texts
from sparklode.llm.superkmer import SHIFT, Alphabet, covered, list_offsets, marks_by_doc, repeated_segments, utf8

#: Bytes of a k-mer by which windows meet.
MINIMIZER_BYTES = 48

#: Entries of one minimizer that are sorted together; more are dealt over tasks and meet by digest afterwards.
TOGETHER = 512

#: Dictionary bytes of one suffix array, not counting minimizers, which holds whole groups; small arrays stay in the processor's caches.
ARRAY_BYTES = 1500


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes in ascending order; text: positive numbers. The end counts as smallest.

    Most groups soon have one suffix, whose pointer moves one suffix of a lower group: that case goes first.
    """
    t = np.array([*text, 0], np.int64)
    n = len(t)
    by_sign = np.argsort(t, kind="stable")
    new = np.r_[True, t[by_sign][1:] != t[by_sign][:-1]]
    begin = np.flatnonzero(new)
    firsts = np.repeat(begin, np.diff(np.r_[begin, n]))
    place, head, sizes = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    place[by_sign], head[by_sign], sizes[begin] = np.arange(n), firsts, np.diff(np.r_[begin, n])
    order, at, group, size = by_sign.tolist(), place.tolist(), head.tolist(), sizes.tolist()  # group: first place of a suffix's group
    previous = [-1] * n
    end = n
    while end > 0:
        i = order[end - 1]
        g = group[i]
        if g == end - 1:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            end = g
            if j >= 0:
                s = group[j]
                m = size[s]
                if m > 1:
                    size[s] = m - 1
                    last = s + m - 1
                    a, other = at[j], order[last]
                    order[a], order[last] = other, j
                    at[other], at[j] = a, last
                    group[j] = last
                    size[last] = 1
            continue
        hits: dict[int, int] = {}
        for i in sorted(order[g:end]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        end = g
        by_count: dict[int, list[int]] = {}
        for j, c in hits.items():
            if c in by_count:
                by_count[c].append(j)
            else:
                by_count[c] = [j]
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[c]:
                s = group[j]
                if size[s] > 1:
                    m = moved.get(s, 0)
                    last = s + size[s] - 1 - m
                    a, other = at[j], order[last]
                    order[a], order[last] = other, j
                    at[other], at[j] = a, last
                    moved[s] = m + 1
            for s, m in moved.items():
                if m < size[s]:
                    size[s] -= m
                    head_ = s + size[s]
                    size[head_] = m
                    for k in range(head_, head_ + m):
                        group[order[k]] = head_
    out, free = [-1] * n, list(range(n))
    out[0] = n - 1
    previous[n - 1] = -2
    for i in out:  # grows as it is read
        j = i - 1
        while j >= 0:
            p = previous[j]
            if p == -2:  # placed
                break
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            previous[j] = -2
            j = p
    return out[1:]


def _common(a: bytes, b: bytes) -> int:
    """Bytes with which both begin."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def _letters(entries: list[bytes], places: list[int], k: int, width: int) -> list[tuple[int, int, int]]:
    """(entry, from, to) of the bytes that one letter stands for: those of the minimizer, of k bytes, with what all entries of the
    same minimizer have beside it, on the left only where no window starts. Lists of these by minimizer; entries
    that cannot share a window with any other, because too little beside the minimizer is equal, are not listed.
    """
    classes: dict[bytes, list[int]] = {}
    for e, p in enumerate(places):
        classes.setdefault(entries[e][p : p + k], []).append(e)
    out = []
    for members in classes.values():
        if len(members) == 1:
            continue
        before = sorted([entries[e][places[e] - 1 :: -1] if places[e] else b"" for e in members])
        after = sorted([entries[e][places[e] + k :] for e in members])
        if max(map(_common, before, before[1:])) + k + max(map(_common, after, after[1:])) < width:
            continue
        left = min(_common(before[0], before[-1]), min(places[e] - len(entries[e]) + width for e in members))
        right = k + _common(after[0], after[-1])
        out.append([(e, places[e] - left, places[e] + right) for e in members])
    return out


def equal_windows(entries: list[bytes], width: int, places: list[int] | None = None, k: int = 0) -> Iterator[list[tuple[int, int]]]:
    """Classes of two or more equal windows over the entries, as (entry, start), from their suffix array.

    places: of each entry's minimizer, which every window of the entry holds, so that equal windows have it at the same place. The bytes
    of a minimizer are one letter then, in which no window but its first byte's starts.
    """
    joined = b"\x00".join(entries) + b"\x00"
    sizes = np.array([len(e) for e in entries], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    signs = np.frombuffer(joined, np.uint8).astype(np.int64) + 2
    signs[ends] = 1  # parts entries; windows never reach over it
    room = np.arange(len(signs)) + width <= np.repeat(ends, sizes + 1)
    owner, starts = np.repeat(np.arange(len(entries)), sizes + 1), begins.tolist()
    if places is None:
        kept = np.arange(len(signs))
    else:
        keep = np.zeros(len(signs), bool)
        for letter, spans in enumerate(_letters(entries, places, k, width), 258):
            for e, a, b in spans:
                lo, hi = starts[e], starts[e] + len(entries[e]) + 1
                keep[lo : lo + a + 1] = True
                keep[lo + b : hi] = True
                signs[lo + a] = letter
        kept = np.flatnonzero(keep)
    order = kept[np.array(suffix_array(signs[kept].tolist()), np.int64)]
    order = order[room[order]].tolist()
    last, members = None, []
    for i in order:
        window = joined[i : i + width]
        if window == last:
            members.append(i)
        else:
            if len(members) > 1:
                yield [(int(owner[m]), m - starts[owner[m]]) for m in members]
            last, members = window, [i]
    if len(members) > 1:
        yield [(int(owner[m]), m - starts[owner[m]]) for m in members]


def _open_entries(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """mini, seg and seg2 (digest), doc_id, at, place (of the minimizer), entry (bytes) of every open segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = batch.column(0), utf8(batch.column(1)), batch.column(2)
            row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
            mark, mini, place = [lists.flatten().field(name) for name in ("mark", "mini", "place")]
            bound = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
            mark = mark.to_numpy(zero_copy_only=False)
            start, width = mark >> SHIFT, mark & ((1 << SHIFT) - 1)
            for lo, hi in chunks(texts):
                a, b = bound[lo], bound[hi]
                if a == b:
                    continue
                spans = zip(row[a:b].tolist(), start[a:b].tolist(), width[a:b].tolist(), strict=True)
                entries = [texts[d][at : at + w - 1 + window] for d, at, w in spans]
                seg = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, entries)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [mini[a:b], pa.array(seg[:, 0]), pa.array(seg[:, 1]), ids.take(pa.array(row[a:b])), pa.array(start[a:b]), place[a:b], pa.array(entries, pa.binary())], names
                )

    names = ["mini", "seg", "seg2", "doc_id", "at", "place", "entry"]
    return docs.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(run, "mini long, seg long, seg2 long, doc_id long, at long, place short, entry binary")


def _runs(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(document, mark) of runs of window starts that follow one another."""
    out: list[list[int]] = []
    for doc, at in sorted(places):
        if out and out[-1][0] == doc and out[-1][1] + out[-1][2] == at and out[-1][2] < (1 << SHIFT) - 1:
            out[-1][2] += 1
        else:
            out.append([doc, at, 1])
    return [(d, (a << SHIFT) | n) for d, a, n in out]


def _sorted_entries(entries: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, mark of windows that are not the first of their class; and, for dealt minimizers, one, two
    (digests) with doc_id and mark of each window that is first among those it was sorted with."""

    def windows_of(group: list[tuple]) -> list[tuple]:
        gone: list[tuple[int, int]] = []
        for places in equal_windows([r[5] for r in group], width, [r[4] for r in group], k):
            where = sorted([(group[e][2], group[e][3] + a) for e, a in places])
            gone += where[1:]
        rows: list[tuple] = [(None, None, d, m) for d, m in _runs(gone)]
        if any(r[1] > 1 for r in group):
            lost = set(gone)
            for _, parts, doc, at, _, entry in group:
                for a in range(len(entry) - width + 1) if parts > 1 else ():
                    if (doc, at + a) not in lost:
                        h = hashlib.blake2b(entry[a : a + width], digest_size=16).digest()
                        rows.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), doc, ((at + a) << SHIFT) | 1))
        return rows

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["one", "two", "doc_id", "mark"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        rows: list[tuple] = []
        total = 0
        for batch in batches:
            for r in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if total > ARRAY_BYTES and group[-1][0] != r[0]:
                    rows += windows_of(group)
                    group, total = [], 0
                    if len(rows) > 50_000:
                        yield batch_of(rows)
                        rows = []
                group.append(r)
                total += len(r[5]) - k
        yield batch_of(rows + (windows_of(group) if group else []))

    return entries.mapInArrow(run, "one long, two long, doc_id long, mark long")


def repeated_bytes(docs: DataFrame, scratch: Scratch, width: int = 100) -> DataFrame:
    """doc_id, mark (start << SHIFT | windows): byte windows that also start earlier (smaller doc_id, or same document)."""
    alphabet = Alphabet(False, width, MINIMIZER_BYTES if width > MINIMIZER_BYTES else 1)
    segments = repeated_segments(docs, alphabet, True, scratch)
    marks = segments.filter("open").select("doc_id", F.struct("mark", "mini", "place").alias("mark"))
    entries = scratch.table(_open_entries(docs, marks_by_doc(marks, "marks"), width), "entries")
    place = F.struct("doc_id", "at")
    folded = scratch.table(entries.groupBy("mini", "seg", "seg2").agg(F.min(place).alias("first")), "folded")
    width_of = F.length("entry") - width + 1
    whole = entries.join(folded, ["mini", "seg", "seg2"])
    again = whole.filter(place != F.col("first")).select("doc_id", (F.shiftleft("at", SHIFT) + width_of).alias("mark"))
    words = folded.groupBy("mini").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / TOGETHER).cast("long")
    words = whole.filter(place == F.col("first")).join(words, "mini").select("mini", parts.alias("parts"), "doc_id", "at", "place", "entry")
    part = F.pmod(F.xxhash64("doc_id", "at"), F.col("parts"))
    # the key of a group takes the place of the minimizer, so that a dealt minimizer is sorted part by part
    dealt = words.select(F.xxhash64("mini", part).alias("mini"), "parts", "doc_id", "at", "place", "entry").repartition("mini").sortWithinPartitions("mini", "doc_id", "at")
    found = scratch.table(_sorted_entries(dealt, width, alphabet.k), "found")
    cross = found.filter("one is not null")
    first = cross.groupBy("one", "two").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = cross.join(first, ["one", "two"]).filter(F.struct("doc_id", "mark") != F.col("first")).select("doc_id", "mark")
    whole_segments = segments.filter("not open").select("doc_id", "mark")
    return whole_segments.unionByName(again).unionByName(found.filter("one is null").select("doc_id", "mark")).unionByName(met)


def cut_bytes(docs: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            row, mark = list_offsets(batch.column(2))
            bound = np.searchsorted(row, np.arange(len(texts) + 1))
            start, runs = mark >> SHIFT, mark & ((1 << SHIFT) - 1)
            removed, spans_n, digests = [], [], []
            for i, text in enumerate(texts):
                a, b = bound[i], bound[i + 1]
                n = spans = 0
                if a < b:
                    gone = covered(np.array([len(text)]), np.array([0, len(text)]), np.zeros(b - a, np.int64), start[a:b], runs[a:b] - 1 + width)
                    n = int(gone.sum())
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                removed.append(n)
                spans_n.append(spans)
                digests.append(hashlib.sha256(text).hexdigest())
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_n, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    joined = docs.join(marks_by_doc(spans, "marks"), "doc_id", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_bytes(documents: DataFrame, width: int = 100) -> DataFrame:
    """Removes each byte covered by a string of width bytes that also starts earlier.

    documents: doc_id, text and other columns, which are left out. A text is its UTF-8 bytes; strings lie in one document
    and are judged on the input; earlier is a smaller doc_id, or the same document and an earlier start, also where both
    overlap. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256. A null or empty text has
    no bytes. Rows without doc_id are left out, rows that repeat a doc_id count as one document (keyed_texts);
    an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "suffixes")
    docs = keyed_texts(documents, "doc_id", "text")
    spans = scratch.table(repeated_bytes(docs, scratch, width), "spans")
    for name in ("segments", "minimizers", "entries", "folded", "found"):
        scratch.drop(name)
    return cut_bytes(docs, spans, width)
