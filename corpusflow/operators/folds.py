"""Next-fit packing in path order, in parallel.

A chunk closes when the next file would take it over the limit; a file over
the limit is a chunk alone.  What a range of files does depends on the range
before only through the words of the chunk that is open when it begins.  So
each range tells, for every file at which its first chunk may begin, how many
chunks follow and what is left open.  Chunks begun at different files soon
begin alike, and what follows only ever changes with a later begin, so this is
a row per distinct outcome.  The driver chains the ranges, and a second pass
numbers the chunks.  Only (path, words) rows are sorted, once they are a table:
nothing is worked out twice, and texts stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..tables import durable

CHUNK_FILES = "chunk_index int, ord int, rel_path string, word_count long"
#: Files of a range, which one task holds as (path, words) rows.
RANGE_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """When a chunk closes: before a file that takes it over ``most`` words,
    and after one that takes it to ``want``."""

    most: int
    want: int | None = None

    def close(self, total: np.ndarray, base):
        """The first file that does not join a chunk that has ``-base`` words
        before the first file, or began where the words up to it are ``base``."""
        out = np.searchsorted(total[1:], base + self.most, side="right")
        return out if self.want is None else np.minimum(out, np.searchsorted(total[1:], base + self.want, side="left") + 1)

    def takes_all(self, total: int, held: int) -> bool:
        """Whether a chunk of ``held`` words is still open after ``total`` more."""
        return held + total <= self.most and (self.want is None or held + total < self.want)


def jumps(words: np.ndarray, rule: Rule, group_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and for a chunk begun at each file where the next begins."""
    total = np.concatenate([[0], np.cumsum(words)])
    after = np.maximum(rule.close(total, total[:-1]), np.arange(len(words)) + 1)
    return total, np.minimum(after, group_end)


def outcome(words: np.ndarray, rule: Rule, group_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums; per place, for a chunk begun there: chunks from there on,
    words left open at the end, and whether a chunk is left open at all."""
    total, after = jumps(words, rule, group_end)
    n = len(words)
    count, left, is_open = np.zeros(n + 1, "int64"), np.zeros(n + 1, "int64"), np.zeros(n + 1, bool)
    for i in range(n - 1, -1, -1):
        j = after[i]
        if j < n:
            count[i], left[i], is_open[i] = count[j] + 1, left[j], is_open[j]
        else:
            held = int(total[n] - total[i])
            count[i], left[i], is_open[i] = 1, held, rule.takes_all(held, 0)
    return total, count, left, is_open


def _ends(group: np.ndarray) -> np.ndarray:
    """For each place the first later one of another group."""
    change = np.flatnonzero(group[1:] != group[:-1]) + 1
    stops = np.r_[change, len(group)]
    return stops[np.searchsorted(stops, np.arange(len(group)), side="right")]


TOLD = "part int, first_group string, last_group string, n long, all_words long, only boolean, at long, need long, least long, count long, left long, open boolean"


def next_fit(files: DataFrame, most: int, key: str = "rel_path", words: str = "word_count", group: str | None = None, want: int | None = None, rows_per_range: int | None = None) -> DataFrame:
    """(key, words, chunk_index from 1) of all rows, in key order.  With
    ``group`` in order of (group, key), no chunk over two groups; with ``want``
    chunks close once they have so many words."""
    rule = Rule(most, want)
    slim = durable(files.select((F.col(group) if group else F.lit("")).alias("g"), F.col(key).alias("k"), F.col(words).cast("long").alias("w")), "fold-rows")
    n = max(1, -(-slim.count() // (rows_per_range or RANGE_ROWS)))
    ranged = durable(slim.repartitionByRange(n, "g", "k").withColumn("part", F.spark_partition_id()), "fold")

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "k"], kind="stable")
        w, g = pdf["w"].to_numpy(), pdf["g"].to_numpy()
        ends = _ends(g)
        total, count, left, is_open = outcome(w, rule, ends)
        reach = int(min(ends[0], rule.close(total, 0))) + 1  # a chunk that is open on entry closes here at last
        same = np.c_[count[:reach], left[:reach], is_open[:reach]]
        first = np.flatnonzero(np.r_[True, (same[1:] != same[:-1]).any(axis=1)])
        rows = {"at": first, "need": total[first], "least": total[np.maximum(first - 1, 0)], "count": count[first], "left": left[first], "open": is_open[first]}
        return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "first_group": g[0], "last_group": g[-1], "n": len(w), "all_words": int(total[-1]), "only": bool(ends[0] == len(w)), **rows})

    told: dict[int, list] = {}
    for r in ranged.groupBy("part").applyInPandas(tell, TOLD).collect():  # a few rows per range
        told.setdefault(r["part"], []).append(r)
    entry: dict[int, tuple[int, int, bool]] = {}
    begun, held, is_open, at = 0, 0, False, None  # chunks so far; words and group of the one that is open
    for part in sorted(told):
        rows = sorted(told[part], key=lambda r: r["at"])
        joins = is_open and at == rows[0]["first_group"]
        entry[part] = (begun, held, joins)
        if joins and rows[0]["only"] and rule.takes_all(rows[0]["all_words"], held):
            held += rows[0]["all_words"]
        else:
            took = rows[0]
            for r in rows[1:] if joins else ():
                if held + r["need"] <= most and (want is None or held + r["least"] < want):
                    took = r
            begun, held, is_open = begun + took["count"], took["left"], took["open"]
        at = rows[0]["last_group"]

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "k"], kind="stable")
        w, ends = pdf["w"].to_numpy(), _ends(pdf["g"].to_numpy())
        before, words_, joins = entry[int(pdf["part"].iloc[0])]
        total, after = jumps(w, rule, ends)
        i, index = int(min(ends[0], rule.close(total, -words_))) if joins else 0, np.full(len(w), before, "int64")
        while i < len(w):
            before += 1
            index[i : after[i]] = before
            i = after[i]
        return pd.DataFrame({"g": pdf["g"], "k": pdf["k"], "w": w, "chunk_index": index.astype("int32")})

    kind = dict(slim.dtypes)["k"]
    out = ranged.groupBy("part").applyInPandas(number, f"g string, k {kind}, w long, chunk_index int")
    return out.select(*([F.col("g").alias(group)] if group else []), F.col("k").alias(key), F.col("w").alias(words), "chunk_index")


def _ordered(rows: DataFrame, by: str = "rel_path") -> DataFrame:
    ord_ = F.row_number().over(W.partitionBy("chunk_index").orderBy(by))
    return rows.withColumn("ord", ord_).select("chunk_index", "ord", "rel_path", "word_count")


def pack_by_size(files: DataFrame, most: int) -> DataFrame:
    """(chunk_index, ord, rel_path, word_count) of (rel_path, word_count)."""
    return _ordered(next_fit(files, most))


def pack_by_module(files: DataFrame, most: int) -> DataFrame:
    """As by size, over whole directories; one over the limit is packed by
    size on its own, in ranges like any, and the next directory begins a new
    chunk."""
    tagged = durable(files.select("rel_path", F.col("word_count").cast("long").alias("word_count"), T.module_of(F.col("rel_path")).alias("module")), "module-files")
    modules = tagged.groupBy("module").agg(F.sum("word_count").alias("word_count"))
    placed = durable(next_fit(modules, most, key="module"), "module-chunks")
    large = placed.where(F.col("word_count") > most).select("module")
    cut = durable(next_fit(tagged.join(large, "module"), most, group="module"), "module-cut")
    # an outer chunk with a large directory is that alone: as many chunks as the directory was cut into
    cuts = cut.groupBy("module").agg(F.min("chunk_index").alias("low"), (F.max("chunk_index") - F.min("chunk_index") + 1).alias("n"))
    outer = placed.join(cuts, "module", "left").groupBy("chunk_index").agg(F.coalesce(F.max("n"), F.lit(1)).cast("long").alias("word_count"))
    before = running(outer, "chunk_index", "word_count")
    base = placed.join(before, "chunk_index").join(cuts.select("module", "low"), "module", "left").select("module", "low", F.col("before").alias("base"))
    whole = tagged.join(large, "module", "left_anti").join(base, "module").select("rel_path", "word_count", (F.col("base") + 1).cast("int").alias("chunk_index"))
    parted = cut.join(base, "module").select("rel_path", "word_count", (F.col("base") + F.col("chunk_index") - F.col("low") + 1).cast("int").alias("chunk_index"))
    return _ordered(whole.unionByName(parted))


def running(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before): the sum of the values of all lesser keys (a row each), in
    ranges; a sum per range reaches the driver."""
    n = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = durable(rows.select(key, value).repartitionByRange(n, key).withColumn("part", F.spark_partition_id()), "running")
    sums = {r["part"]: r["s"] for r in ranged.groupBy("part").agg(F.sum(value).alias("s")).collect()}
    at, base = 0, []
    for part in sorted(sums):
        base.append((part, at))
        at += sums[part]
    offsets = rows.sparkSession.createDataFrame(base, "part int, base long")
    own = F.coalesce(F.sum(value).over(W.partitionBy("part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("own", own).join(offsets, "part").select(key, (F.col("base") + F.col("own")).alias("before"))


def pack_balanced(chunk_files: DataFrame, target: int, most: int) -> DataFrame:
    """Redistribute (chunk_index, ord, rel_path, word_count) over at most
    ``target`` chunks of like size, in their order; no more chunks than that,
    so the last may exceed the limit.  At most ``target`` files: one each."""
    slim = durable(chunk_files.select("chunk_index", "ord", "rel_path", F.col("word_count").cast("long").alias("word_count")), "balanced-rows")
    total = slim.agg(F.count("*").alias("n"), F.sum("word_count").alias("w")).first()
    place = F.struct("chunk_index", "ord", "rel_path")
    keyed = slim.select(place.alias("place"), "word_count")
    if total["n"] <= target:  # a few files
        one = F.row_number().over(W.orderBy("place")).alias("chunk_index")
        return _ordered(keyed.select(one, F.col("place.rel_path").alias("rel_path"), "word_count"))
    # the fold without a limit of chunks, whose later ones are all the last
    found = next_fit(keyed.withColumn("place", F.format_string("%010d/%010d/%s", "place.chunk_index", "place.ord", "place.rel_path")), most, key="place", want=max(0, total["w"] // max(1, target)))
    return _ordered(found.select(F.least("chunk_index", F.lit(max(1, target))).alias("chunk_index"), F.expr("substring(place, 23)").alias("rel_path"), "word_count"))


def chunk_totals(chunk_files: DataFrame, prefix: str = "docs_chunk_") -> DataFrame:
    """(chunk_index, chunk_id, n_files, total_words)."""
    t = chunk_files.groupBy("chunk_index").agg(F.count("*").alias("n_files"), F.sum("word_count").alias("total_words"))
    return t.select("chunk_index", T.chunk_id(F.col("chunk_index"), prefix).alias("chunk_id"), "n_files", "total_words")
