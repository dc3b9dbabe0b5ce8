"""Sequence packing: tokens by a public vocabulary, then hierarchical residual best-fit packing."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.common import Scratch, keyed_texts

#: Words whose ids a worker keeps; the store is emptied when it is full, so memory stays bounded.
CACHED_WORDS = 400_000


class WordTokens:
    """Ids of whole texts. The vocabulary's rules never join what white space parts, so a text's ids are those of its words
    in turn, and words that come again are looked up. A new word of plain letters, with signs behind it or not, is one or two
    units of those rules and goes to the merges directly; any other passes through the whole tokenizer."""

    _of: dict[str, WordTokens] = {}

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merges = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: str) -> WordTokens:
        """One for a worker process, so that its words serve all its tasks."""
        if vocabulary not in cls._of:
            cls._of[vocabulary] = cls(vocabulary)
        return cls._of[vocabulary]

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            ids = self.units[unit] = array("I", [t.id for t in self.merges.tokenize("".join([_BYTE_SIGNS[b] for b in unit.encode()]))]).tobytes()
        return ids

    def _new(self, word: str) -> bytes | None:
        m = _PLAIN.fullmatch(word)
        if not m:
            return None
        return (self._unit(m[1].lower()) if m[1] else b"") + (self._unit(m[2]) if m[2] else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids."""
        rows = [t.split() if not _ODD_SPACE.search(t) else re.split("[ \\t\\n\\r\\f\\v]+", t) for t in texts]
        words = self.words
        if len(words) > CACHED_WORDS:
            words.clear()
            self.units.clear()
        new = set().union(*rows) - words.keys() if rows else set()
        other = []
        for w in new:
            ids = self._new(w)
            if ids is None:
                other.append(w)
            else:
                words[w] = ids
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            words[w] = array("I", e.ids).tobytes()
        return [b"".join(map(words.__getitem__, ws)) for ws in rows]


def _byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_BYTE_SIGNS = _byte_signs()
#: Letters that lower-casing and normalisation take one by one, then ASCII signs that are one unit.
_PLAIN = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]*)([!-&(-/:-@\[-`{-~]*)")
#: White space to split() but not to the vocabulary's rules.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def token_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only where longer than size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = WordTokens.of(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc, ids in zip(part.column(0).to_pylist(), tokens.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, size)):
                        cut = ids[4 * start : 4 * (start + size)]
                        out.append((doc, piece, start, len(cut) // 4, zlib.crc32(cut)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PIECE_TYPES, strict=True)], _PIECE_NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best-fit decreasing: each item, longest first, goes where it leaves the least room. Room is indexed by
    its amount, of which there are at most size kinds, so an item costs a search over those."""
    order = np.argsort(-lengths, kind="stable")
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in order.tolist():
        n = int(lengths[i])
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                del by_room[room]
                rooms.pop(k)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        left = room - n
        if left:
            if left in by_room:
                by_room[left].append(b)
            else:
                by_room[left] = [b]
                insort(rooms, left)
    return bins


def pack(pieces: DataFrame, size: int, scratch: Scratch, items_per_task: int = 20_000, nearly_full: float = 0.995) -> DataFrame:
    """pieces (doc_id, piece, length) with sequence_id and offset.

    Pieces are dealt by hash and packed best-fit in each partition. Bins that are nearly full, or that not even the smallest
    bin left anywhere fits into, are emitted; the others are the items of the next round, in as many partitions as their number
    asks for, so no task ever takes more. Best-fit leaves one bin of half the size or less in a partition, and only with
    such bins can others join: when a round doesn't halve their number, they alone go on, and the rest is emitted. The tree ends
    with a round of one partition, or when nothing can join. A partition takes its rows in order of length and id, so
    a task that is run again makes the same bins.
    """
    # members: (doc_id, piece, offset) of a bin in the order in which they lie
    items = pieces.select(F.array(F.struct("doc_id", "piece", F.lit(0).cast("long").alias("offset"))).alias("members"), F.col("length").alias("total"))
    n = n_members = pieces.count()
    out, level, small_before = None, 0, None
    schema = "sequence_id long, total long, members array<struct<doc_id:long,piece:int,offset:long>>"
    while True:
        parts = max(1, -(-n // items_per_task), -(-n_members // (8 * items_per_task)))
        # dealt by the first member's id, so that a retried task reads the same items
        dealt = items.withColumn("p", F.pmod(F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["piece"], F.lit(level)), F.lit(parts)).cast("int"))
        dealt = dealt.repartition(parts, "p")

        def run(frames: Iterable[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            got = [f for f in frames if len(f)]
            if not got:
                return
            for p, f in pd.concat(got, ignore_index=True).groupby("p", sort=True):
                first = f["members"].map(lambda m: (m[0]["doc_id"], m[0]["piece"]))
                f = f.assign(doc=first.str[0], piece=first.str[1]).sort_values(["total", "doc", "piece"], ascending=[False, True, True], kind="stable")
                lengths, members = f["total"].to_numpy(), f["members"].tolist()
                rows = []
                for k, bin_ in enumerate(best_fit(lengths, size)):
                    inside, at = [], 0
                    for i in bin_:
                        inside += [(m["doc_id"], m["piece"], m["offset"] + at) for m in members[i]]
                        at += int(lengths[i])
                    rows.append(((level << 56) | (int(p) << 32) | k, at, inside))
                yield pd.DataFrame(rows, columns=["sequence_id", "total", "members"])

        made = scratch.table(dealt.mapInPandas(run, schema), f"round{level}")
        least = None if parts == 1 else made.filter(F.col("total") < nearly_full * size).agg(F.min("total")).first()[0]
        if least is None:
            goes_on = F.lit(False)
        else:
            goes_on = (F.col("total") < nearly_full * size) & (F.col("total") + least <= size)
            small = made.filter(goes_on & (2 * F.col("total") <= size)).count()
            if small_before is not None and 2 * small > small_before:
                goes_on = goes_on & (2 * F.col("total") <= size)
            small_before = small
        full = made.filter(~goes_on).select("sequence_id", "members")
        out = full if out is None else out.unionByName(full)
        items = made.filter(goes_on).select("members", "total")
        n, n_members = (0, 0) if least is None else items.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        if not n:
            break
        level += 1
    rows = out.select("sequence_id", F.explode("members").alias("m"))
    return rows.select("sequence_id", F.col("m.doc_id").alias("doc_id"), F.col("m.piece").alias("piece"), F.col("m.offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every document into sequences of at most size tokens: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    docs: doc_id, text and other columns, which are left out. A null or empty text is the end id alone. Rows
    without doc_id are left out; rows that repeat one count as one document (keyed_texts). An empty table gives
    no rows. Pieces of the full size are a sequence each and take no part in the rounds.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(token_pieces(keyed_texts(docs, "doc_id", "text"), vocabulary, size, end_id), "pieces")
    whole = pieces.filter(F.col("length") == size)
    numbered = whole.withColumn("sequence_id", (F.lit(1 << 62).cast("long") + F.monotonically_increasing_id())).withColumn("offset", F.lit(0).cast("long"))
    packed = pack(pieces.filter(F.col("length") < size).select("doc_id", "piece", "length"), size, scratch)
    rest = pieces.filter(F.col("length") < size).join(packed, ["doc_id", "piece"])
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return numbered.select(*cols).unionByName(rest.select(*cols))
