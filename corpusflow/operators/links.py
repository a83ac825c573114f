"""References between chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

try:
    import ahocorasick
except ImportError:  # texts are searched for one by one
    ahocorasick = None


def links(parsed: DataFrame) -> DataFrame:
    """(source_path, ord, target_path, anchor, link_text) of parsed pages."""
    return parsed.select(F.col("rel_path").alias("source_path"), F.inline("links"))


def file_to_chunk(chunk_files: DataFrame, prefix: str = "docs_chunk_") -> DataFrame:
    """(path, chunk_id); a directory's index page also stands for the
    directory, unless a file has that very name."""
    from ..functions.text import chunk_id

    own = chunk_files.select(F.col("rel_path").alias("path"), chunk_id(F.col("chunk_index"), prefix).alias("chunk_id"))
    alias = own.where(F.endswith("path", F.lit("/index.html"))).select(F.expr("left(path, length(path) - 11)").alias("path"), "chunk_id")
    return own.unionByName(alias).groupBy("path").agg(F.max("chunk_id").alias("chunk_id"))


def resolve(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links of packed files with source_chunk and target_chunk (null: the
    target is in no chunk).  A page that most links name is one key of the
    second join; its rows are all on the left of it, where adaptive execution
    parts them."""
    src = chunks.select(F.col("path").alias("source_path"), F.col("chunk_id").alias("source_chunk"))
    dst = chunks.select(F.col("path").alias("target_path"), F.col("chunk_id").alias("target_chunk"))
    return found.join(src, "source_path").join(dst, "target_path", "left")


def unresolved(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("target_chunk").isNull()).select("source_path", "ord", "target_path", "anchor", "link_text")


def totals(edges: DataFrame) -> DataFrame:
    """One row: links, how many are resolved, and pairs of chunks that they join."""
    pair = F.when(F.col("target_chunk").isNotNull(), F.struct("source_chunk", "target_chunk"))
    return edges.agg(F.count("*").alias("links"), F.count("target_chunk").alias("resolved"), F.count_if(F.col("target_chunk").isNull()).alias("unresolved"), F.count_distinct(pair).alias("chunk_pairs"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(chunk_id, references_to, referenced_by, links): chunks in the order in
    which links first name them, and each chunk's resolved links in order."""
    e = edges.where(F.col("target_chunk").isNotNull())
    order = F.struct("source_path", "ord")

    def firsts(of: str, other: str, name: str) -> DataFrame:
        pair = e.groupBy(F.col(of).alias("chunk_id"), F.col(other).alias("other")).agg(F.min(order).alias("at"))
        return pair.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "other"))), lambda x: x["other"]).alias(name))

    mine = e.groupBy(F.col("source_chunk").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("source_path", "ord", "target_path", "target_chunk", "anchor", "link_text"))).alias("links"))
    out = firsts("source_chunk", "target_chunk", "references_to").join(firsts("target_chunk", "source_chunk", "referenced_by"), "chunk_id", "full").join(mine, "chunk_id", "full")
    empty = F.array().cast("array<string>")
    return out.select("chunk_id", F.coalesce("references_to", empty).alias("references_to"), F.coalesce("referenced_by", empty).alias("referenced_by"), F.coalesce("links", F.array().cast(dict(mine.dtypes)["links"])).alias("links"))


#: Entries of a block of a chunk's adjacency.
BLOCK = 10_000


def adjacency_blocks(edges: DataFrame, most: int = BLOCK) -> DataFrame:
    """(kind, chunk_id, block, entries): the adjacency in blocks of at most
    ``most`` entries, which follow each other by ``block``.  kind: to (chunks
    that the chunk references, as other), by (chunks that reference it) and link
    (its resolved links); entries are (source_path, ord, other, target_path,
    anchor, link_text), the latter three of links alone, in order of first naming.

    Rows are dealt by ranges of (kind, chunk, order), so a chunk that is named
    from everywhere is many blocks of several tasks, and no array holds it whole."""
    e = edges.where(F.col("target_chunk").isNotNull())
    none = F.lit(None).cast("string")

    def pairs(kind: str, of: str, other: str) -> DataFrame:
        first = e.groupBy(F.col(of).alias("chunk_id"), F.col(other).alias("other")).agg(F.min(F.struct("source_path", "ord")).alias("at"))
        return first.select(F.lit(kind).alias("kind"), "chunk_id", "at.source_path", "at.ord", "other", *(none.alias(c) for c in ("target_path", "anchor", "link_text")))

    own = e.select(F.lit("link").alias("kind"), F.col("source_chunk").alias("chunk_id"), "source_path", "ord", F.col("target_chunk").alias("other"), "target_path", "anchor", "link_text")
    rows = pairs("to", "source_chunk", "target_chunk").unionByName(pairs("by", "target_chunk", "source_chunk")).unionByName(own)
    order = ("kind", "chunk_id", "source_path", "ord", "other")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    entry = StructType([StructField(c, kinds[c]) for c in ("source_path", "ord", "other", "target_path", "anchor", "link_text")])
    out = StructType([StructField("kind", StringType()), StructField("chunk_id", kinds["chunk_id"]), StructField("block", LongType()), StructField("entries", ArrayType(entry))])
    arrow = to_arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 32, 0
        key, held = None, []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"kind": key[0], "chunk_id": key[1], "block": first + n, "entries": held}], schema=arrow)

        for b in batches:
            for r in b.to_pylist():
                here = (r.pop("kind"), r.pop("chunk_id"))
                if held and (here != key or len(held) >= most):
                    yield block()
                    held, n = [], n + 1
                key = here
                held.append(r)
        if held:
            yield block()

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, out)


def first_places(text: str, wanted: list[str]) -> dict[str, int]:
    """Where each of the texts first stands, of those that do: one pass of an
    Aho-Corasick automaton over all of them, or one search each without it."""
    if ahocorasick is None or len(wanted) < 8:
        return {w: at for w in wanted if (at := text.find(w)) >= 0}
    automaton = ahocorasick.Automaton()
    for w in wanted:
        automaton.add_word(w, w)
    automaton.make_automaton()
    found: dict[str, int] = {}
    for end, w in automaton.iter(text):
        if w not in found:
            found[w] = end + 1 - len(w)
    return found


def marked(text: str, marks: list[tuple[str | None, str | None]]) -> str:
    """The text with `` [-> chunk]`` after the first place of each link text, one
    after the other: (link text, chunk) in order; a text is marked once, empty
    ones never, and neither are links without a chunk.

    All texts are looked for at once in the text as it was.  A mark that was set
    since within a place breaks it, and the next one counts.  Link texts that
    marks themselves may contain or complete are looked for in the text as it
    is by then."""
    todo = [(w.strip(), chunk) for w, chunk in marks if w and w.strip() and chunk is not None]
    signs = "\n".join({f" [-> {chunk}]" for _, chunk in todo})
    touchy = {w for w, _ in todo if "]" in w or " [" in w or w in signs}
    first = first_places(text, list(dict.fromkeys(w for w, _ in todo if w not in touchy)))
    cuts: list[int] = []  # places of marks, ascending
    signs_at: dict[int, list[str]] = {}  # the latest first
    done: set[str] = set()

    def as_it_is() -> str:
        out, lo = [], 0
        for c in cuts:
            out += [text[lo:c], *reversed(signs_at[c])]
            lo = c
        return "".join([*out, text[lo:]])

    for i, (w, chunk) in enumerate(todo):
        if w in done:
            continue
        if w in touchy:
            now = as_it_is()
            at = now.find(w)
            if at >= 0:  # go on from the text as it is
                end = at + len(w)
                return marked_on(f"{now[:end]} [-> {chunk}]{now[end:]}", todo[i + 1 :], done | {w})
            continue
        at = first.get(w, -1)
        while at >= 0 and bisect_right(cuts, at) < bisect_left(cuts, at + len(w)):
            at = text.find(w, at + 1)
        if at < 0:
            continue
        done.add(w)
        end = at + len(w)
        if end not in signs_at:
            insort(cuts, end)
            signs_at[end] = []
        signs_at[end].append(f" [-> {chunk}]")
    return as_it_is()


def marked_on(text: str, todo: list[tuple[str, str]], done: set[str]) -> str:
    return marked(text, [(w, chunk) for w, chunk in todo if w not in done])


@F.pandas_udf(StringType())
def _annotated(texts: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or m is None else marked(t, [(x["link_text"], x["target_chunk"]) for x in m]) for t, m in zip(texts, marks, strict=True)])


def annotate(text, marks):
    """``marked`` of a column; ``marks`` is an array of (link_text,
    target_chunk) in order; without marks the text is as it was.  A batch has
    thousands of rows: for whole chunks there is ``annotate_chunks``."""
    return _annotated(text, marks)


def annotate_chunks(chunks: DataFrame) -> DataFrame:
    """chunks: (chunk_index, name, body, marks), one row per chunk, marks as for
    ``annotate``.  Each chunk is a group, so a task holds one chunk and its
    marks, however many there are."""

    def one(t: pa.Table) -> pa.Table:
        body = [t_ if t_ is None or m is None else marked(t_, [(x["link_text"], x["target_chunk"]) for x in m]) for t_, m in zip(t.column("body").to_pylist(), t.column("marks").to_pylist(), strict=True)]
        return t.select(["chunk_index", "name"]).append_column("body", pa.array(body, pa.string()))

    kind = dict(chunks.dtypes)["chunk_index"]
    return chunks.select("chunk_index", "name", "body", "marks").groupBy("chunk_index").applyInArrow(one, f"chunk_index {kind}, name string, body string")
