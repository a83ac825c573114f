"""Exact top-k by inner product as a Voronoi join.

Pivots group queries and data by nearest pivot.  A summary of each data group
(how many, its radius about the pivot, the largest norm) and a first round,
in which each query sees its own group, bound what a query group can still
need: a data vector y may enter the top k of some query q of group i only if

    p_i . y + r_i |y|  >=  the least k-th score within group i,

since q.y = p_i.y + (q - p_i).y and |q - p_i| <= r_i.  Groups of data whose own
summary rules them out for a query group are not looked at; of the others only
the vectors that pass are replicated, and each query group is solved by blocks.
Scores are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, shuffle_partitions
from .vectors import BLOCK, matrix, pivots, usable

_FOUND = "query_id long, vec_id long, score long"


def _best(q_id: np.ndarray, q: np.ndarray, d_id: np.ndarray, d: np.ndarray, k: int) -> tuple[list, list, list]:
    """k best of the block for each query, without rows of its own id; ties to the smaller id."""
    order = np.argsort(d_id, kind="stable")
    d_id, d = d_id[order], d[order]
    out: tuple[list, list, list] = ([], [], [])
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ d.T
        s[q_id[lo : lo + 256][:, None] == d_id[None, :]] = -np.inf
        for i, row in enumerate(s):
            if len(row) > k:  # all that tie with the k-th stay
                row_at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                row_at = row_at[np.argsort(-row[row_at], kind="stable")][:k]
            else:
                row_at = np.argsort(-row, kind="stable")
            row_at = row_at[np.isfinite(row[row_at])]
            out[0].extend([int(q_id[lo + i])] * len(row_at))
            out[1].extend(d_id[row_at].tolist())
            out[2].extend(row[row_at].astype("int64").tolist())
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "x", rows_per_group: int = 16_384, most_pivots: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` candidates of highest inner
    product for each query; rows of the query's own id are no candidates; ties
    go to the smaller id.  ``column`` holds integers as doubles (an
    array<double>), small enough that products are exact (below 2**53).

    Vectors that are null, empty, or hold null or non-finite components, rows
    without id, and vectors of another length than the query take no part.
    Fewer candidates than ``k``: all of them.  Queries that repeat an id and
    vector count once.  Other columns are ignored; empty tables give an empty
    result.
    """
    spark = rows.sparkSession
    clean = lambda t: t.where(F.coalesce(usable(column), F.lit(False)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x"))
    data = durable(clean(rows), "knn-data")
    asked = durable(clean(queries).distinct(), "knn-queries")
    result = None
    for dim in [r["d"] for r in asked.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]:  # lengths of vectors: a few
        found = _top_k(spark, data.where(F.size("x") == dim), asked.where(F.size("x") == dim), k, rows_per_group, most_pivots)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return result


def _top_k(spark, data: DataFrame, asked: DataFrame, k: int, rows_per_group: int, most_pivots: int) -> DataFrame:
    n = data.count()
    p = pivots(data, "id", "x", min(most_pivots, max(1, -(-n // rows_per_group))))
    if not len(p):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
        home = d2.argmin(axis=1)
        return home, np.sqrt(((x - p[home]) ** 2).sum(axis=1))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = matrix(b.column("x"))
                home, r = near(x)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype("int32")), pa.array(r), pa.array(np.sqrt((x * x).sum(axis=1)))], names=["g", "r", "norm"])

    def summed(t: DataFrame) -> dict[int, tuple[int, float, float]]:
        got = t.select("x").mapInArrow(summary, "g int, r double, norm double").groupBy("g").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("norm").alias("m")).collect()  # one row per pivot
        return {r["g"]: (r["n"], r["r"], r["m"]) for r in got}

    of_data, of_query = summed(data), summed(asked)
    blocks = {g: -(-m // BLOCK) for g, (m, _, _) in of_query.items()}
    # own group first: each query against the data of its group, block by block
    first = _solve(asked, data, near, blocks, {g: {g: None} for g in of_query}, {g: of_data.get(g, (0,))[0] for g in of_query}, p, k, spark)
    first = durable(_ranked(first, k), "knn-first")
    kth = asked.select("id").distinct().join(first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score"), "id", "left")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(near(matrix(b.column("x")))[0].astype("int32")), b.column("score")], names=["g", "score"])

    least = asked.join(kth, "id").select("x", "score").mapInArrow(grouped, "g int, score long").groupBy("g").agg(F.min("score").alias("s"), F.count_if(F.col("score").isNull()).alias("open")).collect()  # one row per pivot
    need: dict[int, dict[int, float | None]] = {}
    for r in least:
        g, (_, radius, _) = r["g"], of_query[r["g"]]
        bound = -np.inf if r["open"] or r["s"] is None else float(r["s"])
        wanted = {}
        for j, (_, rj, mj) in of_data.items():
            most = p[g] @ p[j] + np.sqrt((p[g] ** 2).sum()) * rj + radius * mj
            if j != g and most * (1 + 1e-12) + 1e-6 >= bound:
                wanted[j] = bound
        need[g] = wanted
    radii = {g: v[1] for g, v in of_query.items()}
    second = _solve(asked, data, near, blocks, need, _passing(data, near, need, p, radii), p, k, spark, radii)
    return _ranked(first.select("query_id", "vec_id", "score").unionByName(second), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Rank within a query; every block has sent at most k rows for it."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _takes(need: dict) -> dict[int, list[tuple[int, float | None]]]:
    """For each group of data the query groups that look at it, with their bounds."""
    takes: dict[int, list[tuple[int, float | None]]] = {}
    for g, wanted in need.items():
        for j, bound in wanted.items():
            takes.setdefault(j, []).append((g, bound))
    return takes


def _let_through(x: np.ndarray, at: np.ndarray, to: int, bound: float | None, p: np.ndarray, radii: dict | None) -> np.ndarray:
    """Those of the rows ``at`` that may reach the bound of a query group."""
    if bound is None or not np.isfinite(bound):
        return at
    norm = np.sqrt((x[at] ** 2).sum(axis=1))
    return at[(x[at] @ p[to] + radii[to] * norm) * (1 + 1e-12) + 1e-6 >= bound]


def _passing(data: DataFrame, near, need: dict, p: np.ndarray, radii: dict) -> dict[int, int]:
    """How many data vectors each query group looks at."""
    takes = _takes(need)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"))
            home, n = near(x)[0] if len(b) else np.empty(0, int), {}
            for j in np.unique(home).tolist():
                at = np.flatnonzero(home == j)
                for to, bound in takes.get(j, ()):
                    n[to] = n.get(to, 0) + len(_let_through(x, at, to, bound, p, radii))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["g", "n"])

    return {r["g"]: r["n"] for r in data.select("x").mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}  # one row per pivot


def _solve(asked: DataFrame, data: DataFrame, near, blocks: dict, need: dict, passing: dict, p: np.ndarray, k: int, spark, radii: dict | None = None) -> DataFrame:
    """Queries of group g, in blocks, against the data vectors that ``need``
    lets through to g, in chunks of the data's own hash: as many as the group's
    vectors (``passing``) make, so queries are copied no further."""
    chunks = {g: -(-passing.get(g, 0) // BLOCK) for g in need}
    takes = _takes(need)

    def deal(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, len(b), 1024):
                    part = b.slice(lo, 1024)
                    x, ids = matrix(part.column("x")), part.column("id").to_numpy()
                    home, _ = near(x)
                    h = (ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype("int64")
                    out = []
                    for g in np.unique(home).tolist():
                        at = np.flatnonzero(home == g)
                        if is_query:
                            out += [(i, g, int(h[i] % blocks[g]), c) for i in at.tolist() for c in range(chunks.get(g, 0))]
                            continue
                        for to, bound in takes.get(g, ()):
                            keep = _let_through(x, at, to, bound, p, radii)
                            out += [(i, to, q, int(h[i] % chunks[to])) for i in keep.tolist() for q in range(blocks[to])]
                    if out:
                        row, g_, q_, c_ = zip(*out, strict=True)
                        take = pa.array(row, pa.int64())
                        yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int32()) for v in (g_, q_, c_)], pa.array([is_query] * len(row)), part.column("id").take(take), part.column("x").take(take)], names=["g", "q", "c", "asks", "id", "x"])

        return run

    def solve(table: pa.Table) -> pa.Table:
        asks, ids, x = table.column("asks").to_numpy(zero_copy_only=False), table.column("id").to_numpy(), matrix(table.column("x"))
        a, b, c = _best(ids[asks], x[asks], ids[~asks], x[~asks], k) if asks.any() and not asks.all() else ([], [], [])
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    schema = "g int, q int, c int, asks boolean, id long, x array<double>"
    both = asked.mapInArrow(deal(True), schema).unionByName(data.mapInArrow(deal(False), schema))
    return both.repartition(shuffle_partitions(spark), "g", "q", "c").groupBy("g", "q", "c").applyInArrow(solve, _FOUND)
