"""Mixing sources to target weights with Sainte-Lague apportionment.

The mix has as many words as the corpus.  It is cut into blocks of equal size
that are dealt to sources by highest quotients, then, within each source, to
its shards (hash ranges of its documents).  Where whole blocks
do not fit what its shards may give, the rest is dealt to them in words.  A
shard's documents stand in a
seeded order; the blocks that its quota takes start at a seeded place of that
order and go round, as often as the quota says.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, durable


_SOURCES = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("quota", pa.int64()), ("shards", pa.int32())])


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what
    is cut off is shared again by weight among the rest."""
    out, left, open_ = [0.0] * len(sizes), float(total), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if per * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(claims: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """``seats`` dealt by highest quotients claim/(2n+1), ties to the earlier
    place, none above its cap.  Starts just below the divisor's solution, so
    the heap deals only the last few."""
    claims = np.asarray(claims, float)
    caps = np.where(claims > 0, caps, 0).astype("int64")
    seats = int(min(seats, caps.sum()))
    if not seats:
        return np.zeros(len(claims), "int64")

    def dealt(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(claims / divisor + 0.5).astype("int64"), caps)

    lo, hi = claims.max() * 1e-12 + 1e-300, 2 * claims.max() + 1.0  # many seats, none
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        if dealt(mid).sum() <= seats:
            hi = mid
        else:
            lo = mid
    got = dealt(hi)
    heap = [(-claims[i] / (2 * got[i] + 1), i) for i in range(len(claims)) if got[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-claims[i] / (2 * got[i] + 1), i))
    return got


def _order(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), "doc_id", "_print"), F.col("doc_id"), F.col("size")]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 29, rows_per_shard: int = 2_000, blocks_per_target: int = 1000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``size`` (words of the text; null: 0), ``source_size``, ``target``
    (the source's) and ``taken`` (words that the mix takes of the document,
    repeats counted) to (doc_id, source) of every row, plus ``first_taken``:
    how often the mix takes the block with the document's first word, and the
    columns in ``keep``.

    Sources in code point order, null last, take the weights in turn.  Sources
    without words get nothing.  Rows that share an id are separate documents.
    A block has at most 1/``blocks_per_target`` of the smallest target's words,
    so each source's taken words differ from its target by about one block per
    source.  The result depends on the rows and the seed alone.

    The number of sources must fit the driver (one row each); shards follow
    the number of documents, so a source with a third of all rows has a third
    of all shards.  Documents are dealt to shards by id and text, so one id, or
    none, on a third of all rows is spread like any; texts are measured whole,
    however long.  An empty table stays empty.  ``keep`` may not name a column
    of the result.
    """
    if taken := sorted({"doc_id", "source", "size", "source_size", "target", "taken", "first_taken"} & {*keep}):
        raise ValueError(f"columns of the result: {', '.join(taken)}")
    if inner := sorted({"text", "_print", "shard", "shards", "quota", "start", "stock", "words", "whole", "part", "from", "_s", "_k"} & {*keep}):
        kept = {c: f"_keep{i}" for i, c in enumerate(keep)}
        renamed = docs.select("doc_id", "source", "text", *(F.col(c).alias(kept[c]) for c in keep))
        mixed = mix(renamed, weights, share, most, seed, rows_per_shard, blocks_per_target, tuple(kept.values()))
        return mixed.withColumnsRenamed({v: k for k, v in kept.items()}) if inner else mixed
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = durable(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("_print"), *keep), "mix-sizes")
    per_source = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    total = sum(r["size"] for r in per_source)
    goal = targets([r["size"] for r in per_source], [weights[i % len(weights)] for i in range(len(per_source))], share * total, most)
    block = max(1, int(min((g for g in goal if g > 0), default=1) // blocks_per_target))
    caps = np.array([int(most * r["size"]) // block for r in per_source], "int64")
    quota = sainte_lague(np.array(goal), round(sum(goal) / block), caps) if per_source else np.zeros(0, "int64")
    plan = [(r["source"], r["size"], float(g), int(q), max(1, -(-r["docs"] // rows_per_shard))) for r, g, q in zip(per_source, goal, quota, strict=True)]
    spark = docs.sparkSession
    # a list of rows would go through Python workers of its own kind, which wait beside the others for the rest of the session
    sources = spark.createDataFrame(pa.Table.from_pylist([dict(zip(_SOURCES.names, x, strict=True)) for x in plan], _SOURCES))
    rows = slim.join(sources.withColumnRenamed("source", "_source"), slim["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "_print"), F.col("shards").cast("long")))
    stock = rows.groupBy("source", "shard").agg(F.sum("size").alias("stock"), F.first("quota").alias("quota"))

    def deal(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard", kind="stable")
        room, quota = (most * shards["stock"].to_numpy()).astype("int64"), int(shards["quota"].iloc[0])
        words = block * sainte_lague(shards["stock"].to_numpy(), quota, room // block)
        room = room - words  # less than a block, where seats are left: their words go here
        left = quota * block - words.sum()
        words = words + np.clip(left - (np.cumsum(room) - room), 0, room)
        return shards.assign(words=words)[["source", "shard", "stock", "words"]]

    quotas = stock.groupBy("source").applyInPandas(deal, "source string, shard long, stock long, words long")
    at = W.partitionBy("source", "shard").orderBy(*_order(seed), *keep).rowsBetween(W.unboundedPreceding, -1)
    spans = rows.withColumn("start", F.coalesce(F.sum("size").over(at), F.lit(0)))
    q = quotas.select(F.col("source").alias("_s"), F.col("shard").alias("_k"), "stock", "words")
    joined = spans.join(q, spans["source"].eqNullSafe(F.col("_s")) & (spans["shard"] == F.col("_k")))
    # the quota's words: whole rounds of the shard, and one window that starts at a seeded block and goes round
    joined = joined.withColumn("whole", F.when(F.col("stock") > 0, F.expr("words div stock")).otherwise(0)).withColumn("part", F.when(F.col("stock") > 0, F.expr("words % stock")).otherwise(0))
    blocks = F.greatest(F.lit(1).cast("long"), F.expr(f"stock div {block}"))
    joined = joined.withColumn("from", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), blocks) * F.lit(block))
    zero = F.lit(0).cast("long")

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(zero, F.least(F.col("start") + F.col("size"), hi) - F.greatest(F.col("start"), lo))

    end = F.col("from") + F.col("part")
    extra = overlap(F.col("from"), F.least(end, F.col("stock"))) + overlap(zero, end - F.col("stock"))
    first = ((F.col("start") >= F.col("from")) & (F.col("start") < end)) | (F.col("start") < end - F.col("stock"))
    taken = F.col("whole") * F.col("size") + extra
    first_taken = F.when(F.col("size") > 0, F.col("whole") + first.cast("long")).otherwise(zero)
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), first_taken.alias("first_taken"), *keep)
