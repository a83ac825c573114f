"""Near-duplicate vectors by an exact metric range join.

Vectors lie on the unit sphere; two link when their cosine reaches the
threshold, that is, when their angle is within a radius.  Pivots cut the sphere
into cells (nearest pivot).  A vector is also sent to every other cell whose
border it may reach: its angle to the plane between the two pivots is within
the radius, and, by the triangle inequality, its angle to the pivot is within
the cell's own radius plus the join's.  Cells join apart, in pairs of blocks,
and return per vector how many it links to and the first of its local group.

Equal vectors are one from the start, with a multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, shuffle_partitions
from .graph import components
from .vectors import BLOCK, CHUNK, matrix, pivots, usable

#: Slack of angles and of distances to planes, against rounding in borders.
EPS = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _groups(linked: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least rep it can reach."""
    label = reps.copy()
    while True:
        near = np.where(linked, label[None, :], np.iinfo("int64").max).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", column: str = "embedding", rows_per_cell: int = 32_768, most_pivots: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: other vectors with a
    cosine of at least ``cosine`` in double precision, and the smallest vec_id
    reachable by links.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different lengths with each other.
    Rows that share a vec_id are vectors of their own, each with its own number
    of links, and one node.  Rows
    without id have a null component.  Other columns are ignored; an empty
    table stays empty.  The number of pivots follows the rows and is at most
    ``most_pivots``; larger cells are more block pairs, not larger tasks.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    spark = vectors.sparkSession
    all_ = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("x"))
    good = usable("x") & F.exists("x", lambda v: v != 0) & F.col("id").isNotNull()
    # equal vectors: one row each
    rows = all_.where(F.coalesce(good, F.lit(False)))
    same = rows.groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    same = durable(same.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    n = same.count()
    radius = math.acos(min(1.0, cosine))
    kind = dict(same.dtypes)["x"]
    dims = [r["d"] for r in same.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]  # lengths of vectors: a few
    links = counts = None
    for d in dims:
        part = same.where(F.size("x") == d)
        k = min(most_pivots, max(1, -(-n // rows_per_cell)))
        p = _unit(pivots(part, "rep", "x", k))
        gap = np.sqrt(np.maximum(((p[:, None, :] - p[None, :, :]) ** 2).sum(-1), 0)) if len(p) > 1 else np.zeros((1, 1))

        def homes(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    c = np.clip(_unit(matrix(b.column("x"))) @ p.T, -1, 1)
                    home = c.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(home.astype("int32")), pa.array(np.arccos(c[np.arange(len(c)), home]))], names=["cell", "angle"])

        sums = part.select("x").mapInArrow(homes, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()  # one row per pivot
        reach, held = np.full(len(p), -10.0), np.zeros(len(p), "int64")
        for r in sums:
            reach[r["cell"]], held[r["cell"]] = r["r"], r["n"]
        n_home = np.maximum(1, -(-held // BLOCK))

        def cells(x: np.ndarray, p=p, gap=gap, reach=reach) -> tuple[np.ndarray, np.ndarray]:
            """Home cell of each row; which other cells it visits."""
            c = np.clip(_unit(x) @ p.T, -1, 1)
            at, home = np.arange(len(c)), c.argmax(axis=1)
            near = (np.arccos(c) <= reach[None, :] + radius + EPS) & (c[at, home][:, None] - c <= gap[home] * math.sin(radius) + EPS)
            near[at, home] = False
            return home, near

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    n = cells(matrix(b.column("x")))[1].sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype="int32")), pa.array(n.astype("int64"))], names=["cell", "n"])

        n_visit = np.zeros(len(p), "int64")
        if len(p) > 1:
            for r in part.select("x").mapInArrow(visits, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one row per pivot
                n_visit[r["cell"]] = -(-r["n"] // BLOCK)

        def deal(batches: Iterator[pa.RecordBatch], n_home=n_home, n_visit=n_visit) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, len(b), 512):
                    part_ = b.slice(lo, 512)
                    home, near = cells(matrix(part_.column("x")))
                    h = (part_.column("cls").to_numpy().astype("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype("int64")
                    out: list[tuple[int, int, int, int, int]] = []  # row, cell, left block, right block (visitors: below 0), own home block
                    for i, c in enumerate(home.tolist()):
                        mine = int(h[i] % n_home[c])
                        out += [(i, c, min(mine, o), max(mine, o), mine) for o in range(int(n_home[c]))]
                        out += [(i, c, mine, -1 - v, mine) for v in range(int(n_visit[c]))]
                    for i, c in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                        v = int(h[i] % n_visit[c])
                        out += [(i, c, o, -1 - v, -1) for o in range(int(n_home[c]))]
                    row, cell, left, right, own = zip(*out, strict=True)
                    take = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int32()) for v in (cell, left, right, own)], *[part_.column(n).take(take) for n in ("cls", "times", "x")]], names=["cell", "left", "right", "home", "cls", "times", "x"])

        def join(table: pa.Table) -> pa.Table:
            rep, times, home = (table.column(c).to_numpy() for c in ("cls", "times", "home"))
            x = _unit(matrix(table.column("x")))
            left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
            one, other = np.flatnonzero(home == left), np.flatnonzero(home == right if right >= 0 else home < 0)
            found, times_, ea, eb = [], [], [], []
            for lo in range(0, len(one), CHUNK):
                i = one[lo : lo + CHUNK]
                for lo2 in range(0, len(other), CHUNK):
                    j = other[lo2 : lo2 + CHUNK]
                    near = (x[i] @ x[j].T >= cosine) & (rep[i][:, None] != rep[j][None, :])
                    if not near.any():
                        continue
                    found.append(rep[i])
                    times_.append(near @ times[j])
                    if right > left:  # two home blocks meet once, for both; a visitor is counted in its own cell
                        found.append(rep[j])
                        times_.append(near.T @ times[i])
                    i_, j_ = i[near.any(axis=1)], j[near.any(axis=0)]
                    near = near[near.any(axis=1)][:, near.any(axis=0)]
                    ids, full = np.concatenate([rep[i_], rep[j_]]), np.zeros((len(i_) + len(j_),) * 2, bool)
                    full[: len(i_), len(i_) :], full[len(i_) :, : len(i_)] = near, near.T
                    label = _groups(full, ids)
                    ea.append(ids[ids != label])
                    eb.append(label[ids != label])
            cat = lambda xs: np.concatenate(xs) if xs else np.empty(0, "int64")
            r, c, e, f = cat(found), cat(times_), cat(ea), cat(eb)
            r, c = r[c > 0], c[c > 0]
            return pa.table({"a": pa.array(np.concatenate([r, e]), pa.int64()), "b": pa.array([None] * len(r) + f.tolist(), pa.int64()), "n": pa.array(c.tolist() + [None] * len(e), pa.int64())})

        dealt = part.mapInArrow(deal, "cell int, left int, right int, home int, cls long, times long, x " + kind)
        done = durable(dealt.repartition(shuffle_partitions(spark), "cell", "left", "right").groupBy("cell", "left", "right").applyInArrow(join, "a long, b long, n long"), "vector-links")
        e, c = done.where(F.col("b").isNotNull()).select("a", "b"), done.where(F.col("n").isNotNull()).select("a", "n")
        links, counts = (e, c) if links is None else (links.unionByName(e), counts.unionByName(c))
    if links is None:
        out = all_.withColumn("n_links", F.lit(0).cast("long")).withColumn("root", F.col("id"))
    else:
        # nodes are ids: those of the classes, and of rows with several vectors
        one, other = same.select(F.col("cls").alias("a"), F.col("rep").alias("x")), same.select(F.col("cls").alias("b"), F.col("rep").alias("y"))
        edges = links.join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        torn = rows.groupBy("id").agg(F.min(F.xxhash64("x")).alias("lo"), F.max(F.xxhash64("x")).alias("hi")).where(F.col("lo") != F.col("hi")).select("id")
        edges = edges.unionByName(rows.join(torn, "id").join(same, "x").select(F.col("id").alias("a"), F.col("rep").alias("b")))
        found = components(edges).withColumnRenamed("node", "rep")
        total = counts.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
        named = same.join(total, "cls", "left").join(found, "rep", "left")
        named = named.select("x", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"))
        tagged = all_.withColumn("x", F.when(F.coalesce(good, F.lit(False)), F.col("x")))
        out = tagged.join(named, "x", "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "id").alias("root"))
    root = F.when(F.col("id").isNotNull(), F.col("root"))
    return out.select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(False)).alias("kept"))
