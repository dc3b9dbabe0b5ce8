"""Nearest neighbours over learned partitions.

Nearness is the inner product of the original vectors. Rows get one more coordinate that makes all norms equal, so that
their neighbour graph knows of length as well as direction. The graph of a bounded sample is cut into balanced parts by
recursive bisection; one softmax classifier places rows in parts, another learns in which parts the rows of largest inner
product with a query lie. A query is compared with all rows of its several likeliest parts; how many, is found
on held-out queries that are compared with all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from sparklode.llm.common import Scratch, smallest_hashes

#: Rows on which the graph is made and the router learned.
SAMPLE_ROWS = 4096

#: Rows of the table for each part; parts are a power of two, MOST_PARTS at most.
PART_ROWS, MOST_PARTS = 2000, 256

#: Edges of a row of the graph, and the share of held-out queries' neighbours that the probed parts must hold.
GRAPH_EDGES, SAMPLE_RECALL = 16, 0.97

#: Queries on which the number of probed parts is found; none of them is in the sample.
HELD_QUERIES = 256

#: Rows, and queries, of one task.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product."""
    return _neighbours_of(x, x, k)


def _neighbours_of(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """For each query, the k rows of x of largest inner product other than the row in its own place."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        s = q[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisect(rows: np.ndarray, edges: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the rows with few edges between: median of a smoothed vector, then swaps that gain."""
    place = np.full(int(edges.max()) + 1, -1)
    place[rows] = np.arange(len(rows))
    u = place[np.concatenate((edges[:, 0], edges[:, 1]))]
    v = place[np.concatenate((edges[:, 1], edges[:, 0]))]
    both = (u >= 0) & (v >= 0)
    u, v = u[both], v[both]
    degree = np.bincount(u, minlength=len(rows)) + 1.0
    z = rng.standard_normal(len(rows))
    for _ in range(60):
        z = 0.5 * z + 0.5 * np.bincount(u, weights=z[v], minlength=len(rows)) / degree
        z -= np.average(z, weights=degree)
        z /= np.linalg.norm(z) or 1.0
    side = np.zeros(len(rows), bool)
    side[np.argsort(z, kind="stable")[len(rows) // 2 :]] = True
    for _ in range(10):
        other = np.bincount(u, weights=(side[u] != side[v]).astype(float), minlength=len(rows))
        gain = 2 * other - (degree - 1)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right), max(1, len(rows) // 20))
        swap = gain[left[:n]] + gain[right[:n]] > 1e-9
        if not swap.any():
            break
        side[left[:n][swap]], side[right[:n][swap]] = True, False
    return rows[~side], rows[side]


def cut_graph(x: np.ndarray, parts: int, near: np.ndarray) -> np.ndarray:
    """The part of each row, in parts of equal size."""
    edges = np.column_stack((np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()))
    rng, groups = np.random.default_rng(5), [np.arange(len(x))]
    while len(groups) < parts:
        groups = [half for g in groups for half in _bisect(g, edges, rng)]
    out = np.zeros(len(x), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


def _softmax(s: np.ndarray) -> np.ndarray:
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows of norm 1: divided by the longest norm of the table, with a coordinate that fills them up."""
    x = x / longest
    return np.column_stack((x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))))


def _fit_parts(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Softmax weights, (dimensions + 1) x parts."""
    w = np.zeros((x.shape[1] + 1, target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    rng = np.random.default_rng(6)
    ones = np.column_stack((x, np.ones(len(x))))
    for step in range(1, 601):
        rows = rng.integers(0, len(x), 512)
        g = ones[rows].T @ (_softmax(ones[rows] @ w) - target[rows]) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Router:
    """rows, queries: weights, (dimensions + 1) x parts; longest: the largest norm; centre, spread: of the augmented sample; probes: parts that a query is sent to."""

    rows: np.ndarray
    queries: np.ndarray
    longest: float
    centre: np.ndarray
    spread: float
    probes: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """The part of each row of the table."""
        return np.argmax((augmented(x, self.longest) - self.centre) / self.spread @ self.rows[:-1] + self.rows[-1], axis=1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each query, likeliest first; a query's own length doesn't change what is nearest."""
        return np.argsort(-(_unit(x) @ self.queries[:-1] + self.queries[-1]), axis=1, kind="stable")

    def calibrate(self, x: np.ndarray, query: np.ndarray, parts: np.ndarray) -> None:
        """Sets probes. x: held-out queries; query, parts: for each of their neighbours the query's row in x and the part that holds it."""
        order = self.order(x)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        found = rank[query, parts]
        self.probes = next(p for p in range(1, order.shape[1] + 1) if (found < p).mean() >= SAMPLE_RECALL)


def learn(x: np.ndarray, parts: int, longest: float) -> Router:
    """x: the sample's vectors as they are. All parts are probed until calibrate() says less."""
    a = augmented(x, longest)
    edges = min(GRAPH_EDGES, len(x) - 1)
    near = _neighbours(a, edges)
    part = cut_graph(a, parts, near)
    centre = a.mean(axis=0)
    spread = float(np.sqrt(((a - centre) ** 2).sum(axis=1).mean())) or 1.0

    def shares(near: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), parts))
        np.add.at(out, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0 / near.shape[1])
        return out

    target = shares(near, part)
    target[np.arange(len(x)), part] += 1.0
    router = Router(_fit_parts((a - centre) / spread, target / 2), np.zeros(0), longest, centre, spread, parts)
    router.queries = _fit_parts(_unit(x), shares(_neighbours_of(_unit(x), x, edges), router.place(x)))
    return router


def sound(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part: no null, zero or non-finite vector, and of the length that most have
    (the longer, if two are as common). Of rows that repeat an id the smallest vector stands for it."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = embeddings.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    limit = F.lit(float("inf"))
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit)) & F.exists("v", lambda c: c != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    if not sizes:
        return rows
    rows = rows.filter(F.size("v") == sizes[0]["n"])
    if not rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def best_of(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k nearest of the rows, exactly: inner product in double precision, ties to the smaller id.

    Equal vectors are one candidate with its ids in order, so they tie exactly.
    """
    rows = rows.sort_values("vec_id", kind="stable")
    x = _matrix(rows["v"])
    ids = rows["vec_id"].to_numpy()
    _, first, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
    which = which.ravel()
    by_kind = np.argsort(which, kind="stable")
    bound = np.searchsorted(which[by_kind], np.arange(len(first) + 1))
    kinds = x[first]
    out_q, out_v, out_s = [], [], []
    for lo in range(0, len(queries), 256):
        part = queries.iloc[lo : lo + 256]
        q, qid = _matrix(part["v"]), part["vec_id"].to_numpy()
        s = q @ kinds.T
        take = min(k + 9, len(kinds))
        near = np.argpartition(-s, take - 1, axis=1)[:, :take]
        score = (q[:, None, :] * kinds[near]).sum(axis=2)
        for i in range(len(part)):
            order = np.argsort(-score[i], kind="stable")
            got: list[tuple[float, int]] = []
            for j in order.tolist():
                value = float(score[i, j])
                if len(got) > k and -got[k][0] > value:
                    break
                kind = near[i, j]
                members = ids[by_kind[bound[kind] : bound[kind] + min(k + 1, bound[kind + 1] - bound[kind])]]
                got += [(-value, int(m)) for m in members if m != qid[i]]
                if len(got) > k:
                    got.sort()
            got = sorted(got)[:k]
            out_q += [int(qid[i])] * len(got)
            out_v += [g[1] for g in got]
            out_s += [-g[0] for g in got]
    return pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.float64)})


def _search(index: DataFrame, asked: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """index: part, vec_id, v. asked: part, vec_id, v, a row for each part that a query is sent to. sizes: part, n, nq.

    Each part is compared in blocks of rows and queries, so a part of any size is many tasks.
    """
    blocks = sizes.select("part", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("rb"), F.ceil(F.col("nq") / BLOCK_QUERIES).cast("int").alias("qb"))

    def of(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")
        # fresh columns: both sides come from one table
        df = df.select(*[F.expr(c).alias(c) for c in ("part", "vec_id", "v")])
        return df.join(F.broadcast(blocks), "part").withColumn(own + "i", mine).withColumn(other + "i", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("part", "rbi", "qbi", "vec_id", "v")

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return best_of(queries, rows, k)

    keys = ["part", "rbi", "qbi"]
    found = of(asked, "qb", "rb").groupBy(*keys).cogroup(of(index, "rb", "qb").groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    ranked = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product that each query finds, nearest first.

    embeddings: key and vector (arrays of numbers); other columns are left out. is_query: a condition on the key column that
    picks the queries; every row but the query's own is a candidate. Which rows take part is said in sound(); an
    empty table gives no rows. Tables of up to two parts' rows are one part, which makes the search exact; a query that finds
    fewer than k in its parts is compared with all rows. The graph and the router come from sample_rows rows at
    most, those with the smallest hashes of their ids; every row is indexed. HELD_QUERIES queries at most, which are left out of
    that sample, are compared with all rows to find how many parts are probed.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.table(sound(embeddings, key, vector), "rows")
    n = rows.count()
    parts = min(MOST_PARTS, 1 << max(0, (n // PART_ROWS).bit_length() - 1))
    router = None
    if parts > 1:
        longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))).first()[0]
        held = scratch.table(smallest_hashes(rows.filter(is_query).select("vec_id"), "vec_id", HELD_QUERIES), "held")
        fitted = smallest_hashes(rows.select("vec_id").join(F.broadcast(held), "vec_id", "left_anti"), "vec_id", sample_rows)
        sample = rows.join(F.broadcast(fitted), "vec_id").collect()
        router = learn(np.array([r["v"] for r in sorted(sample, key=lambda r: r["vec_id"])]), parts, longest)

    # 0 for every row, but no constant: the joins on it stay joins by key
    one_part = F.pmod(F.xxhash64("vec_id"), F.lit(1)).cast("int").alias("part")

    def in_all(queries: DataFrame) -> DataFrame:
        """The exact search of few queries."""
        whole = rows.select(one_part, "vec_id", "v")
        sizes = whole.groupBy("part").agg(F.count("*").alias("n")).join(queries.groupBy("part").agg(F.count("*").alias("nq")), "part")
        return _search(whole, queries, sizes, k)

    if router is not None:
        asked = scratch.table(rows.join(F.broadcast(held), "vec_id").select(one_part, "vec_id", "v"), "held_rows")
        near = scratch.table(in_all(asked).select("query_id", "vec_id"), "held_near")
        where = rows.join(F.broadcast(near), "vec_id").select("query_id", "v").collect()  # HELD_QUERIES * k rows at most
        queries = asked.select("vec_id", "v").collect()
        if where:
            at = {r["vec_id"]: i for i, r in enumerate(queries)}
            router.calibrate(np.array([r["v"] for r in queries]), np.array([at[r["query_id"]] for r in where]), router.place(np.array([r["v"] for r in where])))

    @F.pandas_udf(T.IntegerType())
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.zeros(len(v), np.int32) if router is None or not len(v) else router.place(_matrix(v)).astype(np.int32))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def route(v: pd.Series) -> pd.Series:
        if router is None or not len(v):
            return pd.Series([[0]] * len(v))
        return pd.Series(list(router.order(_matrix(v))[:, : router.probes].astype(np.int32)))

    index = scratch.table(rows.select(place("v").alias("part"), "vec_id", "v"), "placed")
    asked = scratch.table(rows.filter(is_query).select(F.explode(route("v")).alias("part"), "vec_id", "v"), "asked")
    sizes = index.groupBy("part").agg(F.count("*").alias("n")).join(asked.groupBy("part").agg(F.count("*").alias("nq")), "part")
    out = scratch.table(_search(index, asked, sizes, k), "found")
    if parts > 1:
        need = min(k, n - 1)
        short = out.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= need).select("query_id")
        left = rows.filter(is_query).join(short, F.col("vec_id") == F.col("query_id"), "left_anti").select("vec_id", "v")
        if not left.isEmpty():
            left = scratch.table(left.select(one_part, "vec_id", "v"), "left")
            more = in_all(left)
            out = out.join(left.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    return out.select("query_id", "rank", "vec_id", "score")
