"""Pages that are empty shells of applications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import SHELL_CHARS

# Fewer files than this, any shell counts; else the share.
SMALL_SAMPLE, SHELL_SHARE = 5, 0.7


def shells(parsed: DataFrame, least_chars: int = SHELL_CHARS) -> DataFrame:
    """(rel_path, shell) of parsed .html files."""
    own = parsed.where(F.endswith("rel_path", F.lit(".html")))
    return own.select("rel_path", ((F.col("body_chars") < least_chars) | F.col("app_root")).alias("shell"))


def is_spa(found: DataFrame) -> DataFrame:
    """One row: files, shells, and whether the tree is an application's."""
    t = found.agg(F.count("*").alias("files"), F.count_if("shell").alias("shells"))
    few = F.col("shells") > 0
    return t.select("files", "shells", F.when(F.col("files") == 0, False).when(F.col("files") < SMALL_SAMPLE, few).otherwise(F.col("shells") / F.col("files") > SHELL_SHARE).alias("spa"))
