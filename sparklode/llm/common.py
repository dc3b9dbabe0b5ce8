"""Helpers that the corpus operators share: table access, scratch tables, text buffers in numpy."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles at once; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named in spark.checkpoint.dir. Where that is unset, a session of one machine (as in
    tests) sets a temporary one; on a cluster executors would not see it, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparklode-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written to the shared folder so that lineage ends there; drop() removes one that is no longer read.

    A result reads its last tables when it is used, so those stay until clear(), or until the caller that wrote the
    result elsewhere says clear(since).
    """

    #: Folders that this process has made and not removed.
    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self.base)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.base}/{name}")

    @classmethod
    def clear(cls, spark: SparkSession, since: int = 0) -> None:
        """Removes the folders made since that many of them were there."""
        for at in cls.made[since:]:
            remove(spark, at)
        del cls.made[since:]


def keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key long, text string) with one row a key: rows without a key are left out, and of rows
    that repeat a key the byte-wise smallest text stands for it. The repeat is looked for in the
    key column alone, so tables with unique keys pay no text shuffle."""
    two = df.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias(text)).filter(F.col(key).isNotNull())
    if two.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return two
    return two.groupBy(key).agg(F.min(text).alias(text))


def smallest_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows (unique keys) with the smallest hashes of their keys. Hashes are spread evenly, so a bound
    on the hash leaves about 1.5 n rows, and tasks send few rows to the one that sorts, however many there are."""
    h = F.xxhash64(key)
    total = df.count()
    if total > 2 * n:
        df = df.filter(h < F.lit(int(-(2**63) + 1.5 * n / total * 2**64)))
    return df.orderBy(h, key).limit(n)


def chunks(items: list[bytes]) -> list[tuple[int, int]]:
    """Index ranges of consecutive items of about CHUNK_BYTES together."""
    out, start, total = [], 0, 0
    for i, item in enumerate(items):
        if total and total + len(item) > CHUNK_BYTES:
            out.append((start, i))
            start, total = i, 0
        total += len(item) + 1
    if start < len(items):
        out.append((start, len(items)))
    return out


_MASK = (1 << 64) - 1


def _odd_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Roller:
    """Polynomial hashes modulo 2**64 of spans of a sequence, from prefix sums. Different spans can be made whose hashes are
    equal, so these choose minimizers and minima only; what is equal is decided by digests() or by the texts."""

    def __init__(self, seed: int):
        self.base = int(_odd_numbers(seed, 1)[0])
        self.inverse = pow(self.base, -1, 1 << 64)
        self.power, self.back = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            for name, value in (("power", self.base), ("back", self.inverse)):
                steps = np.full(n, value, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: uint64. Prefix sums, one longer than the values."""
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((prefix[ends] - prefix[starts]) * self.back[starts])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all spans of one width, not yet mixed: their high bits are good enough to choose by."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (prefix[width:] - prefix[:n]) * self.back[:n]


BYTE_VALUES = np.random.default_rng(20240601).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_bounds(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; the buffer must end in a byte that is none."""
    inside = is_word[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


def byte_table(pattern_bytes: list[int]) -> np.ndarray:
    """True for bytes that belong to words; pattern_bytes: those that separate."""
    table = np.ones(256, bool)
    table[pattern_bytes] = False
    return table


#: \x20 and \x09-\x0D separate words.
SPACE_TABLE = byte_table([0x20, *range(0x09, 0x0E)])


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Digests of the bytes of spans themselves, as rows of size // 8 numbers: those that decide what is equal."""
    make = hashlib.blake2b
    joined = b"".join([make(raw[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(joined, np.int64).reshape(-1, size // 8)


def quick_digests(raw: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The same by a faster hash (XXH3), for many short spans."""
    make = xxhash.xxh3_64_digest if size == 8 else xxhash.xxh3_128_digest
    joined = b"".join([make(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(joined, np.int64).reshape(-1, size // 8)


def first_min(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of each window of that width, by the hashes' high halves (doubling). A value and its
    position are one number, so the smaller of two is found in one step."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 32) - 1)
    best, have = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return (best[:n] & low).astype(np.int64)
