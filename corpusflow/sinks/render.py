"""Chunks as Markdown, text and JSON lines, and what goes with them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators import links
from ..operators.split import split_files
from .files import write_files

# Fixed values, here and below: names of JSON keys, of files and their headers, as readers of the chunks expect them.
SCHEMA_VERSION = "v1"
RULE = "=" * 60


def parts(chunk_files: DataFrame, docs: DataFrame, most: int, urls: DataFrame | None = None, scores: DataFrame | None = None, context: bool = True) -> DataFrame:
    """One row per file, or per piece of a file that has headings: what the
    writers need.  docs: (rel_path, text, headings); null headings: the file is
    written without context.  Without ``context`` that is so for every file:
    none is cut, and no text passes through Python."""
    if context:
        pieces = split_files(docs.select("rel_path", "text", "headings"), most).drop("char_offset")
        pieces = pieces.join(docs.select("rel_path", F.col("headings").isNotNull().alias("context")), "rel_path")
    else:
        one, text = F.lit(1), F.coalesce("text", F.lit(""))
        pieces = docs.select("rel_path", one.alias("sub_ord"), one.alias("sub_total"), text.alias("text"), F.array().cast("array<string>").alias("breadcrumb"), F.lit(False).alias("context"))
    out = chunk_files.join(pieces, "rel_path")
    if urls is not None:
        out = out.join(urls, "rel_path", "left")
    else:
        out = out.withColumn("url", F.lit(None).cast("string"))
    if scores is not None:
        s = scores.select("chunk_index", F.struct(T.half_even(F.col("score"), 2).alias("score"), "grade", T.half_even(F.col("noise_ratio"), 3).alias("noise_ratio")).alias("readiness"))
        out = out.join(s, "chunk_index", "left")
    else:
        out = out.withColumn("readiness", F.lit(None).cast("struct<score: double, grade: string, noise_ratio: double>"))
    return out.withColumn("words", T.word_count(F.col("text")))


def context_header(row: dict, tag: str = "context-v1") -> str:
    """The JSON comment above a piece: only what is known, nothing if nothing is."""
    known = {"source": row["rel_path"] or None, "url": row["url"] or None}
    if row["sub_total"] > 1:
        known |= {"chunk_index": row["sub_ord"], "total_chunks": row["sub_total"]}
    known |= {"word_count": row["words"] or None, "context_breadcrumb": row["breadcrumb"] or None, "llm_readiness": row["readiness"]}
    known = {k: v for k, v in known.items() if v is not None}
    if not known:
        return ""
    return f"<!-- {tag}\n{json.dumps(known | {'schema_version': SCHEMA_VERSION}, indent=2, ensure_ascii=False)}\n-->\n\n"


def jsonl(rows: DataFrame) -> DataFrame:
    """(chunk_index, ord, sub_ord, line): a JSON object per part; what is
    absent is left out."""
    split = F.col("sub_total") > 1
    index = F.format_string("%02d", "chunk_index")
    id_ = F.when(split, F.concat_ws("_", index, F.col("sub_ord").cast("string"), "rel_path")).otherwise(F.concat_ws("_", index, "rel_path"))
    crumbs = F.when(F.col("context") & (F.size("breadcrumb") > 0), F.col("breadcrumb"))
    record = F.struct(
        id_.alias("id"), F.col("rel_path").alias("source"), "words", F.col("text").alias("content"), F.lit(SCHEMA_VERSION).alias("schema_version"),
        crumbs.alias("breadcrumb"), F.when(split, F.col("sub_ord")).alias("chunk_index"), F.when(split, F.col("sub_total")).alias("total_chunks"),
        "url", F.when(F.col("context"), F.col("readiness.grade")).alias("readiness_grade"),
    )
    return rows.select("chunk_index", "ord", "sub_ord", F.to_json(record).alias("line"))


def _index(form: str, total: int) -> Column:
    n, files = F.format_string("%02d", F.col("chunk_index")), F.col("files")
    listed = F.array_join(F.transform(files, lambda f: F.concat(F.lit("- "), f["rel_path"], F.lit(" ("), f["word_count"].cast("string"), F.lit(" words)\n"))), "")
    held = F.format_string("(%d files, ~%d words):\n", F.size(files), F.col("total_words"))
    if form == "md":
        return F.concat(F.lit("# Chunk "), n, F.lit(f" of {total:02d}\n\n## Files in this chunk "), held, listed, F.lit("\n---\n\n"))
    return F.concat(F.lit("Chunk "), n, F.lit(f" of {total:02d}\nFiles in this chunk "), held, listed, F.lit(f"\n{RULE}\n\n"))


def bodies(rows: DataFrame, form: str = "md", with_index: bool = True, tag: str = "context-v1", prefix: str = "docs_chunk_", total: int | None = None, context: bool = True) -> DataFrame:
    """(chunk_index, name, body) of every chunk file; ``context`` as for
    ``parts``.  A chunk is bounded by its words, so its parts fit one row."""
    if form == "jsonl":
        lines = jsonl(rows).groupBy("chunk_index").agg(F.array_sort(F.collect_list(F.struct("ord", "sub_ord", "line"))).alias("x"))
        out = lines.select("chunk_index", F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).alias("body"))
    else:
        source = F.concat(F.lit("<!-- SOURCE: "), "rel_path", F.lit(" -->\n\n")) if form == "md" else F.concat(F.lit("=== SOURCE: "), "rel_path", F.lit(" ===\n\n"))
        text = F.concat(F.when(F.col("context"), _header(tag)).otherwise(source) if context else source, "text")
        chunk = rows.select("chunk_index", F.struct("ord", "sub_ord", text.alias("text")).alias("part"), F.when(F.col("sub_ord") == 1, F.struct("ord", "rel_path", "word_count")).alias("file"))
        chunk = chunk.groupBy("chunk_index").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.array_sort(F.collect_list("file")).alias("files"), F.sum("file.word_count").alias("total_words"))
        body = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
        n = total if total is not None else chunk.count()
        out = chunk.select("chunk_index", (F.concat(_index(form, n), body) if with_index else body).alias("body"))
    return out.select("chunk_index", F.concat(T.chunk_id(F.col("chunk_index"), prefix), F.lit(f".{form}")).alias("name"), "body")


def _header(tag: str) -> Column:
    """``context_header`` of each part; its text stays out of Python."""

    @F.arrow_udf(StringType())
    def made(rows: pa.Array) -> pa.Array:
        return pa.array([context_header(r, tag) for r in rows.to_pylist()], pa.string())

    return made(F.struct("rel_path", "url", "sub_ord", "sub_total", "words", "breadcrumb", "readiness"))


def write(chunks: DataFrame, folder: str) -> DataFrame:
    """Write (name, body) rows as files of ``folder``, all or none; returns
    (name, bytes)."""
    return write_files(chunks, folder)


def import_guide(totals: DataFrame, chunk_files: DataFrame, headings: DataFrame | None = None, preset: str = "notebooklm", form: str = "md") -> str:
    """A Markdown table of the chunks, with each one's section: the first
    heading of its first file, else that file's directory, else its name."""
    first = chunk_files.where(F.col("ord") == 1).select("chunk_index", "rel_path")
    if headings is not None:
        first = first.join(headings.select("rel_path", F.try_element_at("headings", F.lit(1))["text"].alias("title")), "rel_path", "left")
    else:
        first = first.withColumn("title", F.lit(None).cast("string"))
    folder = F.element_at(F.split(T.module_of(F.col("rel_path")), "/"), -1)
    name = F.regexp_replace(F.col("rel_path"), r"(?<=.)\.[^./]*$", "")
    section = F.coalesce("title", F.when(F.contains("rel_path", F.lit("/")), folder).otherwise(name))
    rows = totals.join(first, "chunk_index").select("chunk_index", "chunk_id", "total_words", section.alias("section")).orderBy("chunk_index").collect()  # a row per chunk
    words = sum(r["total_words"] for r in rows)
    out = ["# Import guide" + (": NotebookLM" if preset == "notebooklm" else ""), "", f"- Sources: {len(rows)} chunks", f"- Words: {words:,}"]
    if preset == "notebooklm":
        out += ["- Limits: 50 sources, 500,000 words each", "", "Upload the files in this order."]
    out += ["", "| # | File | Words | Section |", "|---|------|-------|---------|"]
    out += [f"| {r['chunk_index']} | {r['chunk_id']}.{form} | {r['total_words']:,} | {r['section']} |" for r in rows]
    return "\n".join(out) + "\n"


def readiness_json(scores: DataFrame) -> str:
    rows = scores.orderBy("chunk_index").collect()  # a row per chunk
    grades = {g: sum(r["grade"] == g for r in rows) for g in "ABC"}
    mean = sum(r["score"] for r in rows) / len(rows) if rows else 0.0
    chunks = [{"chunk_id": r["chunk_id"], "word_count": r["word_count"], "noise_ratio": round(r["noise_ratio"], 3), "boundary_integrity": r["boundary_integrity"], "context_depth": r["context_depth"], "score": round(r["score"], 3), "grade": r["grade"]} for r in rows]
    return json.dumps({"summary": {"total_chunks": len(rows), "avg_score": round(mean, 3), "grades": grades}, "chunks": chunks}, indent=2)


def cross_refs_lines(edges: DataFrame, most: int = links.BLOCK) -> Iterator[str]:
    """cross_refs.json of edges (as ``links.resolve`` gives them), a block of a
    chunk's adjacency at a time: what is held at once is one block."""
    blocks = links.adjacency_blocks(edges, most)
    kinds = (("to", "references_to"), ("by", "referenced_by"), ("link", "links"))
    rank = F.create_map(*(x for i, (k, _) in enumerate(kinds) for x in (F.lit(k), F.lit(i))))[F.col("kind")]
    at, kind, more = None, None, False
    yield "{"

    def upto(name: str | None) -> Iterator[str]:
        """Close the open list, and give those up to ``name`` that have no entry."""
        nonlocal kind
        names = [n for _, n in kinds]
        if kind is not None:
            yield "\n    ]" if more else "]"
        for n in names[names.index(kind) + 1 if kind else 0 : names.index(name) + 1 if name else None]:
            yield f"{',' if n != names[0] else ''}\n    {json.dumps(n)}: ["
            if n != name:
                yield "]"
        kind = name

    for r in blocks.withColumn("_rank", rank).orderBy("chunk_id", "_rank", "block").toLocalIterator():
        if r["chunk_id"] != at:
            if at is not None:
                yield from upto(None)
                yield "\n  },"
            at = r["chunk_id"]
            yield f"\n  {json.dumps(at, ensure_ascii=False)}: {{"
        name = dict(kinds)[r["kind"]]
        if name != kind:
            yield from upto(name)
            more = False
        for x in r["entries"]:
            made = x["other"] if name != "links" else {"source_file": x["source_path"], "target_file": x["target_path"], "target_chunk": x["other"], "anchor": x["anchor"], "link_text": x["link_text"]}
            yield ("," if more else "") + "\n      " + json.dumps(made, indent=2, ensure_ascii=False).replace("\n", "\n      ")
            more = True
    if at is not None:
        yield from upto(None)
        yield "\n  },"
    yield '\n  "unresolved": ['
    comma = ""
    for r in links.unresolved(edges).orderBy("source_path", "ord").toLocalIterator():
        made = {"source_file": r["source_path"], "target_file": r["target_path"], "anchor": r["anchor"], "link_text": r["link_text"]}
        yield f"{comma}\n    " + json.dumps(made, indent=2, ensure_ascii=False).replace("\n", "\n    ")
        comma = ","
    yield "\n  ]\n}" if comma else "]\n}"


def cross_refs_json(adjacency: DataFrame, unresolved: DataFrame) -> str:
    out: dict = {}
    for r in adjacency.orderBy("chunk_id").toLocalIterator():
        links = [{"source_file": x["source_path"], "target_file": x["target_path"], "target_chunk": x["target_chunk"], "anchor": x["anchor"], "link_text": x["link_text"]} for x in r["links"]]
        out[r["chunk_id"]] = {"references_to": r["references_to"], "referenced_by": r["referenced_by"], "links": links}
    out["unresolved"] = [{"source_file": r["source_path"], "target_file": r["target_path"], "anchor": r["anchor"], "link_text": r["link_text"]} for r in unresolved.orderBy("source_path", "ord").toLocalIterator()]
    return json.dumps(out, indent=2, ensure_ascii=False)


def delta_json(diff: DataFrame, chunk_files: DataFrame, timestamp: str | None = None, prefix: str = "docs_chunk_") -> str:
    """What changed and which chunks hold it; the time is now, in UTC, unless it
    is given."""
    timestamp = timestamp if timestamp is not None else datetime.now(timezone.utc).isoformat()
    keys = {s: [r["key"] for r in diff.where(F.col("status") == s).orderBy("key").toLocalIterator()] for s in ("added", "modified", "removed")}
    made = chunk_files.groupBy("chunk_index").agg(F.array_sort(F.collect_list(F.struct("ord", "rel_path"))).alias("f")).orderBy("chunk_index")
    chunks = [{"chunk": f"{prefix}{r['chunk_index']:02d}", "files": [x["rel_path"] for x in r["f"]]} for r in made.toLocalIterator()]
    return json.dumps({"timestamp": timestamp, **keys, "chunks_generated": chunks}, indent=2, ensure_ascii=False)
