"""Cutting a long text at structure, and the headings above each piece."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_ITEM = re.compile(r"\s*(?:[-*+]|\d+\.)\s")
FENCE = "```"
#: Files whose pieces a task holds at once.
SLICE = 128


def _kind(paragraph: str) -> str:
    """What a paragraph begins: a fence or <pre> still open, an item, a row, or prose."""
    if paragraph.lstrip().startswith(FENCE):
        marks = sum(line.strip().startswith(FENCE) for line in paragraph.split("\n"))
        return "prose" if marks >= 2 else "fence"
    low = paragraph.lower()
    if "<pre" in low and "</pre>" not in low:
        return "pre"
    if _ITEM.match(paragraph):
        return "item"
    return "row" if paragraph.strip().startswith("|") else "prose"


def _ends(kind: str, paragraph: str) -> bool:
    return paragraph.rstrip().endswith(FENCE) if kind == "fence" else "</pre>" in paragraph.lower()


def _follows(kind: str, paragraph: str) -> bool:
    return bool(_ITEM.match(paragraph)) if kind == "item" else paragraph.strip().startswith("|")


def structural_blocks(paragraphs: list[str]) -> list[str]:
    """Paragraphs joined where a fence, a <pre>, a list or a table spans them."""
    out: list[list[str]] = []
    state = "prose"  # what the last block still takes
    for p in paragraphs:
        if state in ("fence", "pre"):
            out[-1].append(p)
            if _ends(state, p):
                state = "prose"
        elif state in ("item", "row") and _follows(state, p):
            out[-1].append(p)
        else:
            out.append([p])
            state = _kind(p)
    return ["\n\n".join(b) for b in out]


def pieces(text: str | None, most: int) -> list[tuple[str, int]]:
    """(piece, offset in the text) of at most ``most`` words, more only where
    one structural block has more.  No limit or no text: one piece."""
    if not text or most <= 0:
        return [(text or "", 0)]
    out, begin, at, held, parts = [], 0, 0, 0, []
    for block in structural_blocks(text.split("\n\n")):
        n = len(block.split())
        if parts and held + n > most:
            out.append(("\n\n".join(parts), begin))
            begin, held, parts = at, 0, []
        parts.append(block)
        held, at = held + n, at + len(block) + 2
    return [*out, ("\n\n".join(parts), begin)]


def standing(headings: list[dict], offsets: list[int]) -> Iterator[list[str]]:
    """Texts of the headings above each of ascending positions, by level.  One
    pass: a heading ends those of its own and deeper levels, so what stands is a
    stack of ascending levels."""
    stack: list[dict] = []
    at = 0
    for offset in offsets:
        while at < len(headings) and headings[at]["char_offset"] <= offset:
            while stack and stack[-1]["level"] >= headings[at]["level"]:
                stack.pop()
            stack.append(headings[at])
            at += 1
        yield [h["text"] for h in stack]


def crumbs(headings: list[dict] | None, offsets: list[int], first: bool = True) -> list[list[str]]:
    """The breadcrumb of each piece of a file; a first piece with nothing above
    it has that of the file's first heading."""
    if not headings:
        return [[] for _ in offsets]
    out = list(standing(headings, offsets))
    if first and out and not out[0]:
        out[0] = next(standing(headings, [headings[0]["char_offset"]]))
    return out


def split_files(docs: DataFrame, most: int) -> DataFrame:
    """docs: (rel_path, text, headings).  (rel_path, sub_ord from 1, sub_total,
    text, char_offset, breadcrumb) of every piece; only files with headings are
    cut.  A file's headings are walked once, along with its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, lo in ((b, lo) for b in batches for lo in range(0, len(b), SLICE)):
            b = whole.slice(lo, SLICE)
            row, ord_, total, text, offset, crumb = [], [], [], [], [], []
            for i, (t, h) in enumerate(zip(b.column("text").to_pylist(), b.column("headings").to_pylist(), strict=True)):
                found = pieces(t, most if h else 0)
                above = crumbs(h, [at for _, at in found])
                for j, (piece, at) in enumerate(found, 1):
                    for column, x in zip((row, ord_, total, text, offset, crumb), (i, j, len(found), piece, at, above[j - 1]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([b.column("rel_path").take(pa.array(row, pa.int64())), pa.array(ord_, pa.int32()), pa.array(total, pa.int32()), pa.array(text, pa.string()), pa.array(offset, pa.int32()), pa.array(crumb, pa.list_(pa.string()))], names=["rel_path", "sub_ord", "sub_total", "text", "char_offset", "breadcrumb"])

    return docs.select("rel_path", "text", "headings").mapInArrow(run, "rel_path string, sub_ord int, sub_total int, text string, char_offset int, breadcrumb array<string>")


@F.pandas_udf(ArrayType(StringType()))
def _crumb(headings: pd.Series, offsets: pd.Series, ords: pd.Series) -> pd.Series:
    return pd.Series([crumbs(None if h is None else list(h), [int(at)], n == 1)[0] for h, at, n in zip(headings, offsets, ords, strict=True)])


def breadcrumbs(split: DataFrame) -> DataFrame:
    """Adds ``breadcrumb`` to single pieces (headings, char_offset, sub_ord), as
    ``split_files`` does to a file's."""
    return split.withColumn("breadcrumb", _crumb("headings", "char_offset", "sub_ord"))
