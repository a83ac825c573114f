"""What a run would do, and what it did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def file_stats(docs: DataFrame) -> DataFrame:
    """(rel_path, raw_words, extracted_words, words): ``words`` are those left
    by the last stage that ran."""
    last = F.coalesce(F.col("words_after_dedup"), F.col("extracted_words")) if "words_after_dedup" in docs.columns else F.col("extracted_words")
    return docs.select("rel_path", "raw_words", "extracted_words", last.alias("words"))


def totals(stats: DataFrame, most: int) -> DataFrame:
    """One row: files, raw, extracted and effective words, floored reduction, oversize files."""
    t = stats.agg(F.count("*").alias("files"), F.sum("raw_words").alias("raw_words"), F.sum("extracted_words").alias("extracted_words"), F.sum("words").alias("words"), F.count_if(F.col("words") > most).alias("oversize"))
    return t.withColumn("reduction", F.when(F.col("raw_words") > 0, F.expr("(raw_words - extracted_words) * 100 div raw_words")))


def top_files(stats: DataFrame, n: int = 10) -> DataFrame:
    """The files of most words: rank, short path, words, percentage removed."""
    cut = F.when((F.col("raw_words") > 0) & (F.col("raw_words") != F.col("words")), F.expr("(raw_words - words) * 100 div raw_words"))
    return stats.select(T.short_path(F.col("rel_path")).alias("name"), "rel_path", "words", cut.alias("removed")).orderBy(F.desc("words"), "rel_path").limit(n)


def dry_run(stats: DataFrame, chunks: int, most: int, max_chunks: int, strategy: str, found: int, excluded: int, dedup: DataFrame | None = None, scores: DataFrame | None = None) -> str:
    """The report as text: one row of totals and ten of files reach the driver."""
    t = totals(stats, most).first()
    words = t["words"] or 0
    out = ["", "Dry run, nothing written", f"  Found:       {found:,} files, {excluded:,} excluded, {t['files']:,} processed", f"  Words:       {t['raw_words'] or 0:,} raw, {t['extracted_words'] or 0:,} extracted"]
    if t["reduction"] is not None:
        out.append(f"  Reduction:   {t['reduction']}%")
    if dedup is not None:
        d = dedup.first()
        share = d["words_removed"] * 100 // t["extracted_words"] if t["extracted_words"] else 0
        out += [f"  Left:        {words:,} words after removing {d['words_removed']:,} ({share}%)", f"  Blocks gone: {d['removed_exact']} exact, {d['removed_fuzzy']} fuzzy"]
    out += [f"  Strategy:    {strategy}, {most:,} words a chunk", f"  Chunks:      {chunks} of at most {max_chunks}"]
    if t["oversize"]:
        out.append(f"  Oversize:    {t['oversize']} files exceed the limit alone")
    out.append("  Largest files:")
    for i, r in enumerate(top_files(stats).collect(), 1):
        out.append(f"  {i:>2}. {r['name']:<40} {r['words']:>9,} words" + (f"  (-{r['removed']}%)" if r["removed"] is not None else ""))
    if chunks:
        out.append(f"  Mean:        ~{words // chunks:,} words a chunk")
    if scores is not None:
        out.append("  Readiness (boundaries not verifiable):")
        for r in scores.orderBy("chunk_index").collect():  # a row per chunk
            out.append(f"  {r['chunk_id']:<20} {r['score']:.2f} {r['grade']} noise {r['noise_ratio']:.1%} depth {r['context_depth']}")
    return "\n".join([*out, ""])


def pack_summary(chunks: DataFrame, excluded: int, max_chunks: int, most: int) -> dict:
    """Counts of a finished run and its warnings."""
    r = chunks.agg(F.count("*").alias("chunks"), F.sum("n_files").alias("files"), F.sum("total_words").alias("words"), F.min("total_words").alias("least"), F.max("total_words").alias("most"), F.count_if(F.col("total_words") > most).alias("over")).first()
    warnings = [f"{r['over']} chunk(s) exceed the word limit"] * bool(r["over"]) + [f"{r['chunks']} chunks exceed the limit of {max_chunks}"] * (r["chunks"] > max_chunks)
    return {"files": r["files"] or 0, "excluded": excluded, "chunks": r["chunks"], "words": r["words"] or 0, "average": (r["words"] or 0) / r["chunks"] if r["chunks"] else 0, "least": r["least"], "most": r["most"], "warnings": warnings}


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """One row: files of the manifest and their bytes."""
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def download_summary(manifest: DataFrame, downloaded: int, skipped: int) -> dict:
    """What a fetch brought: files by what became of them, and the tree's size."""
    t = manifest_totals(manifest).first()
    return {"files": t["files"], "downloaded": downloaded, "skipped": skipped, "megabytes": round(t["bytes"] / (1 << 20), 1)}
