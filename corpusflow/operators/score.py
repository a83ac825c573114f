"""How fit chunks are for a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def chunk_scores(chunk_files: DataFrame, docs: DataFrame, prefix: str = "docs_chunk_", with_text: bool = True) -> DataFrame:
    """docs: (rel_path, raw_words, extracted_words, headings, text).  Per
    chunk: words, noise_ratio, boundary_integrity, context_depth, score, grade.
    Boundaries are tested per file (a chunk joins whole files by empty lines);
    a dry run takes them for whole."""
    level = F.array_max(F.transform("headings", lambda h: h["level"]))
    fences, opened, closed = (F.regexp_count("text", F.lit(x)) for x in ("```", f"(?i)<pre[{T.SPACE}>]", "(?i)</pre>"))
    zero = F.lit(0)
    cols = [F.col("rel_path"), "raw_words", "extracted_words", F.coalesce(level, zero).alias("level")]
    cols += [x.alias(n) for x, n in ((fences, "fences"), (opened, "opened"), (closed, "closed"), (T.word_count(F.col("text")), "text_words"))] if with_text else [zero.alias(n) for n in ("fences", "opened", "closed", "text_words")]
    j = chunk_files.join(docs.select(*cols), "rel_path")
    s = j.groupBy("chunk_index").agg(*[F.sum(c).alias(c) for c in ("raw_words", "extracted_words", "fences", "opened", "closed", "text_words")], F.max("level").alias("context_depth"))
    noise = T.noise_ratio(F.col("raw_words"), F.col("extracted_words"))
    whole = (F.coalesce("fences", zero) % 2 == 0) & (F.coalesce("opened", zero) == F.coalesce("closed", zero))
    s = s.withColumn("noise_ratio", noise).withColumn("boundary_integrity", whole)
    s = s.withColumn("score", T.readiness(F.col("noise_ratio"), F.col("boundary_integrity"), F.col("context_depth")))
    return s.select("chunk_index", T.chunk_id(F.col("chunk_index"), prefix).alias("chunk_id"), F.col("text_words").alias("word_count"), "noise_ratio", "boundary_integrity", "context_depth", "score", T.grade(F.col("score")).alias("grade"))


def summary(scores: DataFrame) -> DataFrame:
    """One row: chunks, mean score, chunks of each grade."""
    return scores.agg(F.count("*").alias("total_chunks"), F.avg("score").alias("avg_score"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABC"])
