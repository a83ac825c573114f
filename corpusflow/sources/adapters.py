"""Tables of pages and texts as files of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FILE = ("rel_path", "size_bytes", "mtime", "content")


def pages_as_files(pages: DataFrame) -> DataFrame:
    """host/first segment/p<page_id>.html"""
    host, first = T.url_part(F.col("url"), 2), F.try_element_at(T.segments(T.url_part(F.col("url"), 3)), F.lit(1))
    path = F.concat_ws("/", host, first, F.format_string("p%08d.html", "page_id"))
    return pages.select(path.alias("rel_path"), F.octet_length("html").cast("long").alias("size_bytes"), F.col("page_id").cast("double").alias("mtime"), F.col("html").alias("content"))


def documents_as_files(documents: DataFrame) -> DataFrame:
    """source/lang/<doc_id>.txt"""
    path = F.concat_ws("/", "source", "lang", F.format_string("%010d.txt", "doc_id"))
    return documents.select(path.alias("rel_path"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("n_chars").cast("double").alias("mtime"), F.col("text").alias("content"))
