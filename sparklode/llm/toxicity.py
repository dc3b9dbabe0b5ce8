"""Toxicity by noisy-channel deobfuscation.

Suspicious spans (tokens with digits, signs, separators or repeated letters, and letters set apart) become character lattices;
Viterbi decoding under a trigram model of the corpus' letters restores them, and words and word
beginnings of the restored text are scored with weights learnt from labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.common import CHUNK_BYTES, Scratch, keyed_texts, smallest_hashes
from sparklode.llm.quality import fit

#: Labelled rows to learn from, those with the smallest hashes of their ids; a third of them only calibrates the score.
TRAIN_ROWS = 20_000

#: A feature's weight is shrunk by so many of its standard errors, so that one seen in few rows needs to be clearer; and the
#: least weight that is left of a feature which counts.
SHRINK, LEAST_WEIGHT = 1.5, 2.0

#: Word beginnings that count as features, besides whole words.
BEGINNINGS = (4, 5, 6)

#: Signs that are read as letters (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}

#: Log-probabilities of the channel: a sign for a letter, a separator between letters dropped or kept, repetition undone.
READ, JOIN, KEEP, TWICE, ONCE = -1.0, -0.3, -1.5, -0.7, -2.0

#: Characters of the longest span whose reading is kept for its next occurrence.
LONGEST_KNOWN = 64

#: Symbols of the letter model: 0 is any boundary, 1-26 a-z, 27 other letters.
SYMBOLS = 28

_SIGN = re.escape("".join(LEET))
#: A sign or separator: neither letter nor digit.
_BETWEEN = r"(?:[^\w\s]|_)"
#: What the lattice may read as other letters: signs, letters that repeat, and letters with something between. Accents are folded before.
_SUSPECT = re.compile(rf"[{_SIGN}]|([^\W\d_])\1|[^\W\d_]{_BETWEEN}+[^\W\d_]")
_LEETED = re.compile(f"[{_SIGN}]")
_TRAIL = re.compile(r"(?:[^\w\s][^\w\s]+|[.,;:?\"')\]])+$")
#: Single letters and signs set apart, by any number of separators as in the lattice.
_APART = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_SIGN}])(?:(?:[^\w{_SIGN}]|_)+(?:[^\W_]|[{_SIGN}])(?![^\W_])){{2,}}")
_WORD = re.compile(r"[^\W\d_]+")
_UNSEEN = re.compile("[­​-‍⁠﻿]")


def _fold_table() -> np.ndarray:
    """Symbol of each code point up to U+024F: Latin letters go by their base letter."""
    out = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c).lower())[0]
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif chr(c).isalpha():
            out[c] = {"ß": 19, "ø": 15, "æ": 1, "œ": 15}.get(chr(c).lower(), SYMBOLS - 1)
    return out


_FOLD = _fold_table()


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 0x250, _FOLD[np.minimum(points, 0x24F)], SYMBOLS - 1)


_SYMBOL = {chr(c): s for c, s in enumerate(_FOLD.tolist())}
#: Accented letters and their base letters.
_BASE = {c: chr(96 + s) for c, s in _SYMBOL.items() if ord(c) > 127 and 0 < s < SYMBOLS - 1}
_ACCENTED = re.compile(f"[{''.join(_BASE)}]")


def folded(text: str) -> str:
    return "".join(chr(96 + s) if 0 < s < SYMBOLS - 1 else c for c, s in zip(text, symbols_of(text).tolist(), strict=True))


def letter_counts(docs: DataFrame) -> DataFrame:
    """gram, n: the letter trigrams of all whole texts; a partition sends at most SYMBOLS**3 rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            part: list[str] = []
            size = 0

            def add() -> None:
                s = symbols_of("  ".join(["", *part, ""]).lower()).astype(np.int64)
                total[:] += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)

            for text in batch.column(1).to_pylist():
                if text:
                    part.append(text)
                    size += len(text)
                if size > CHUNK_BYTES:
                    add()
                    part, size = [], 0
            if part:
                add()
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(total[grams])], ["gram", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class LetterModel:
    """Log-probabilities of letter trigrams, interpolated with bigrams and single letters."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c3[0, 0, 0] = 0
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).ravel().tolist()

    def restore(self, lattice: list[list[tuple[tuple[int, ...], float]]]) -> str:
        """The likeliest reading. A step of the lattice has emissions (symbols, perhaps none) with their costs."""
        log, n = self.log, SYMBOLS
        # a state, the last two symbols, is one number, so that with the next symbol it is a place in log
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for step in [*lattice, [((0,), 0.0)]]:
            after: dict[int, tuple[float, tuple | None]] = {}
            if len(step) == 1 and len(step[0][0]) == 1 and step[0][0][0]:
                c, cost = step[0][0][0], step[0][1]
                for key, (score, path) in states.items():
                    key = key * n + c
                    s = score + cost + log[key]
                    key %= n * n
                    old = after.get(key)
                    if old is None or s > old[0]:
                        after[key] = (s, (c, path))
                states = after
                continue
            for key, (score, path) in states.items():
                for emitted, cost in step:
                    k, s, p = key, score + cost, path
                    for c in emitted:
                        if c == 0 and k % n == 0:
                            continue
                        k = k * n + c
                        s += log[k]
                        k %= n * n
                        p = (c, p)
                    old = after.get(k)
                    if old is None or s > old[0]:
                        after[k] = (s, p)
            states = after
        _, path = max(states.values(), key=lambda v: v[0])
        out = []
        while path:
            out.append(" " if path[0] == 0 else chr(96 + path[0]) if path[0] < n - 1 else "�")
            path = path[1]
        return "".join(reversed(out)).strip()


def lattice_of(span: str) -> list[list[tuple[tuple[int, ...], float]]]:
    steps = []
    other = SYMBOLS - 1
    symbols = [_SYMBOL.get(c, other) for c in span]
    i = 0
    while i < len(span):
        c, s, j = span[i], symbols[i], i + 1
        if s:
            while j < len(span) and symbols[j] == s:
                j += 1
            if j - i == 1:
                steps.append([((s,), 0.0)])
            elif j - i == 2:
                steps.append([((s, s), 0.0), ((s,), ONCE)])
            else:
                steps.append([((s,), 0.0), ((s, s), TWICE)])
        elif c in LEET:
            while j < len(span) and span[j] == c:
                j += 1
            letters = [ord(x) - 96 for x in LEET[c]]
            options = [((x,), READ) for x in letters] + [((0,), 2 * KEEP)]
            if j - i > 1:
                options += [((x, x), READ + TWICE) for x in letters]
            steps.append(options)
        else:
            while j < len(span) and not symbols[j] and span[j] not in LEET:
                j += 1
            steps.append([((), JOIN), ((0,), KEEP)])
        i = j
    return steps


class Restorer:
    def __init__(self, model: LetterModel):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}  # of tokens
        self.read_before: dict[str, tuple[str, ...]] = {}  # of parts of tokens, and of spans

    def read(self, span: str) -> str:
        """Spans of any length are decoded whole: the work grows with the length, the states do not."""
        return self.model.restore(lattice_of(span))

    @staticmethod
    def keep(store: dict[str, tuple[str, ...]], span: str, words: tuple[str, ...]) -> tuple[str, ...]:
        if len(span) <= LONGEST_KNOWN:
            if len(store) > 200_000:
                store.clear()
            store[span] = words
        return words

    def read_part(self, span: str) -> tuple[str, ...]:
        out = self.read_before.get(span)
        return self.keep(self.read_before, span, tuple(dict.fromkeys(self.read(span).split()))) if out is None else out

    def read_token(self, token: str) -> tuple[str, ...]:
        """The words that a token is restored to, none if it has one reading only. One with punctuation after it is read without
        it, and as a whole too where some of that could be letters."""
        core = token if token.isalpha() else _TRAIL.sub("", token)
        parts = [core] if core is token or not _LEETED.search(token, len(core)) else [token, core]
        found = [w for p in parts if len(p) > 1 and _SUSPECT.search(p) for w in self.read_part(p)]
        return self.keep(self.known, token, tuple(dict.fromkeys(found)))

    def words(self, text: str) -> set[str]:
        """The distinct words of a text, lower-cased, with those that its suspicious spans are restored to."""
        low = text.lower()
        if not low.isascii():
            low = _UNSEEN.sub("", low)
        words = set(_WORD.findall(low))
        if not low.isascii():
            low = _ACCENTED.sub(lambda m: _BASE[m[0]], low)
        known = self.known
        for token in set(low.split()):
            out = known.get(token)
            if out is None:
                out = self.read_token(token)
            if out:
                words.update(out)
        for m in _APART.finditer(low):
            words.update(self.read_part(m[0]))
        return words


def features_of(words: set[str]) -> set[str]:
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in words if len(w) >= n])
    return out


def _learn(sample: DataFrame, model: LetterModel) -> dict[str, float]:
    """Weights of features: log of how much likelier a toxic row holds it, shrunk. sample: doc_id, text, y; its size bounds the features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts, rows = Restorer(model), (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update(features_of(restorer.words(text or "")))
                rows[y] += 1
        keys = list(counts[0].keys() | counts[1].keys())
        out = [(k, counts[1][k], counts[0][k]) for k in keys] + [("", rows[1], rows[0])]
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["feature", "n1", "n0"])

    counts = sample.select("text", "y").mapInArrow(run, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).persist()
    total = counts.filter("feature = ''").first()
    if total is None:
        return {}
    weight = F.log((F.col("n1") + 0.5) / (total["n1"] + 1.0)) - F.log((F.col("n0") + 0.5) / (total["n0"] + 1.0)) - SHRINK * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    kept = counts.filter("feature != '' and n1 > 0").withColumn("w", weight).filter(F.col("w") >= LEAST_WEIGHT)
    out = {r["feature"]: r["w"] for r in kept.collect()}
    counts.unpersist()
    # restored spans have base letters only
    return out | {f: w for k, w in out.items() if (f := folded(k)) not in out}


def evidence(words: set[str], weights: dict[str, float], by_kind: tuple[frozenset[str], ...]) -> list[float]:
    """What the features of a text say together: the largest weight, and the sum over words of theirs, damped."""
    best: dict[str, float] = {w: weights[w] for w in words & by_kind[0]}
    for n, known in zip(BEGINNINGS, by_kind[1:], strict=True):
        if known:
            for w in words:
                if w[:n] in known and len(w) >= n:
                    best[w] = max(best.get(w, 0.0), weights[w[:n] + "*"])
    return [max(best.values(), default=0.0), float(np.log1p(sum(best.values())))]


def _kinds(weights: dict[str, float]) -> tuple[frozenset[str], ...]:
    return (frozenset(k for k in weights if not k.endswith("*")), *(frozenset(k[:-1] for k in weights if k.endswith("*") and len(k) == n + 1) for n in BEGINNINGS))


def score_toxicity(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text, modulo 3, is 1), score (0 to 1), predicted (1 if score >= threshold).

    documents: doc_id, text; labels: doc_id, toxic (0, 1); other columns are left out. The letter model counts all whole texts;
    labels are learnt from rows not held out. An empty or null text has no features, and so the lowest score.
    Rows without doc_id are left out, rows that repeat a doc_id count as one document (keyed_texts); labels that
    contradict one another, or are null, teach nothing. Without labels of both kinds every score is 0.5.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    docs = keyed_texts(documents, "doc_id", "text")
    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in scratch.table(letter_counts(docs), "letters").collect():  # SYMBOLS**3 rows at most
        counts[r["gram"]] = r["n"]
    model = LetterModel(counts)
    remainder = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(3))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(remainder("doc_id") != 1)
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).filter("y = y1").select("doc_id", "y")
    chosen = smallest_hashes(marks.join(docs.select("doc_id"), "doc_id"), "doc_id", train_rows)
    sample = scratch.table(docs.join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))), "sample")
    weights = _learn(sample.filter("part != 0"), model)
    kinds = _kinds(weights)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            x = [evidence(restorer.words(t or ""), weights, kinds) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64())], ["doc_id", "most", "sum"])

    schema = "doc_id long, most double, sum double"
    seen = sample.filter("part = 0").select("doc_id", "text").mapInArrow(score, schema).join(sample.select("doc_id", "y"), "doc_id").select("most", "sum", "y").collect()
    y = np.array([r["y"] for r in seen], float)
    if weights and 0 < y.sum() < len(y):
        w = fit(np.array([[r["most"], r["sum"]] for r in seen]), y, ridge=0.02)
        logit = F.lit(float(w[2])) + float(w[0]) * F.col("most") + float(w[1]) * F.col("sum")
        value = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    else:
        value = F.lit(0.5)
    out = docs.select("doc_id", "text").mapInArrow(score, schema)
    return out.select("doc_id", (remainder("doc_id") == 1).alias("held_out"), value.alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
