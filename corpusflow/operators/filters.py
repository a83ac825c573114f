"""Which files are packed: suffixes, ignore patterns, deltas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def pattern_lines(content: str | None, inline: tuple[str, ...] = ()) -> list[str]:
    """Patterns of an ignore file, without blank lines and comments, then those given."""
    lines = [x.strip() for x in (content or "").splitlines()]
    return [x for x in lines if x and not x.startswith("#")] + [x for x in inline if x]


def _glob(part: str) -> str:
    """One path segment as a regular expression."""
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        elif c == "[" and (end := part.find("]", i + 2)) > 0:
            inner = part[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def compile_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression of whole relative paths, excludes?) of one gitignore
    pattern.  A pattern with a slash before its end is anchored; one with a
    trailing slash matches directories; whatever lies below a match matches."""
    negated = line.startswith("!")
    body = line[1:] if negated else line
    body = body.removeprefix("\\") if body[:2] in ("\\!", "\\#") else body
    only_dir = body.endswith("/")
    body = body.rstrip("/")
    if not body:
        return None
    anchored = "/" in body
    parts = [p for p in body.split("/") if p]
    regex = "" if anchored else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            regex += ".+" if last else "(?:.*/)?"
        else:
            regex += _glob(part) + ("" if last else "/")
    if parts[-1] == "**":
        tail = ""
    else:
        tail = "/.*" if only_dir else "(?:/.*)?"
    return f"(?s)^{regex}{tail}$", not negated


def ignored(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches decides; none: not ignored."""
    out = F.lit(False)
    for line in patterns:
        found = compile_pattern(line)
        if found:
            out = F.when(path.rlike(found[0]), F.lit(found[1])).otherwise(out)
    return out


def filter_files(files: DataFrame, ignore_file: str | None = None, ignore: tuple[str, ...] = (), skip_binary: bool = True) -> DataFrame:
    """Files that are neither binary by suffix nor ignored.  Both are tests of
    the path alone and so run before any content is read."""
    path = F.col("rel_path")
    keep = ~ignored(path, pattern_lines(ignore_file, ignore))
    return files.where(keep & ~T.is_binary(path) if skip_binary else keep)


def changed_only(files: DataFrame, diff: DataFrame) -> DataFrame:
    """Files that a manifest diff calls added or modified."""
    return files.join(diff.where(F.col("status").isin("added", "modified")).select(F.col("key").alias("rel_path")), "rel_path", "left_semi")


def content_filter(url: Column, include: tuple[str, ...]) -> Column:
    """Whether a fetch keeps the URL: with the default text suffixes all but
    assets, with others only those, with none everything."""
    want = {x.strip().lstrip(".").lower() for x in include if x.strip()}
    own = F.regexp_extract(F.lower(T.url_part(url, 3)), r"\.([^./]+)$", 1)
    if not want:
        return F.lit(True)
    if want == {"html", "md", "txt"}:
        return ~own.isin(*ASSETS)
    return own.isin(*sorted(want))


# Suffixes of assets that a fetch of texts leaves out.
ASSETS = (
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "tiff",
    "css", "js", "mjs", "map",
    "woff", "woff2", "ttf", "eot", "otf",
    "pdf", "zip", "gz", "tar", "bz2", "7z", "rar",
    "mp4", "webm", "mov", "avi", "mp3", "wav", "ogg",
    "exe", "dmg", "bin", "wasm",
)
