"""HTML pages: text, main content, headings, links.

A page is parsed once into a tape of events, and everything is read off tapes.
Pages are parsed event by event, not as a tree, and the parser is not closed,
so an unfinished construct at the end of a page is lost.  Main content becomes
HTML again before its boilerplate is removed; its character references have
then been decoded, so escaped markup counts as markup from there on.
"""

from __future__ import annotations

import html as entities
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END, TEXT = 0, 1, 2

# Elements whose end parts blocks of text.
BLOCK_TAGS = frozenset({
    "p", "div", "section", "article", "main",
    "h1", "h2", "h3", "h4", "h5", "h6",
    "li", "tr", "blockquote", "pre", "ul", "ol",
    "table", "dl", "dt", "dd", "figcaption", "figure", "hr",
})

# Places of main content, best first: tag, attribute, value.
MAIN_PLACES = (
    ("main", None, None),
    ("div", "role", "main"),
    ("article", None, None),
    ("div", "id", "content"),
    ("div", "id", "main-content"),
    ("div", "class", "content"),
    ("div", "class", "main-content"),
    ("div", "class", "markdown-body"),
    ("div", "class", "documentation-content"),
    ("div", "class", "doc-content"),
)

# Boilerplate by tag, by part of a class, by part of an id.
BOILERPLATE_TAGS = frozenset({"nav", "header", "footer", "aside", "script", "style", "noscript", "iframe", "svg"})
BOILERPLATE_CLASSES = (
    "breadcrumb", "breadcrumbs", "sidebar", "side-bar", "side-nav",
    "toc", "table-of-contents", "navbar", "nav-bar", "navigation",
    "footer", "page-footer", "site-footer", "cookie", "cookie-banner",
    "copy-button", "copy-to-clipboard", "version-selector",
    "version-banner", "version-warning", "feedback",
    "was-this-helpful", "edit-this-page", "edit-on-github",
    "announcement", "announcement-banner",
)
BOILERPLATE_IDS = ("navbar", "sidebar", "footer", "toc", "table-of-contents", "breadcrumb", "cookie-consent", "announcement-bar")
SILENT_TAGS = frozenset({"script", "style", "noscript", "iframe", "svg"})
SHELL_IDS = frozenset({"root", "__next", "app"})

# Fixed values of the density rule.
DENSE_TAGS, NAV_TAGS = frozenset({"div", "section"}), frozenset({"nav", "header", "footer", "aside"})
LINK_COST, NAV_COST, LEAST_DENSITY = 3, 50, 50

EXTERNAL = ("http://", "https://", "mailto:", "javascript:")
SHELL_CHARS = 200


class _Tape(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.events.append((START, tag, attrs))

    def handle_endtag(self, tag):
        self.events.append((END, tag, None))

    def handle_data(self, data):
        self.events.append((TEXT, data, None))


def tape_of(page: str) -> list[tuple]:
    parser = _Tape()
    parser.feed(page)
    return parser.events


def _attr(attrs: list, name: str) -> str:
    """The last value of the attribute; absent or without value: empty."""
    return next((v for k, v in reversed(attrs) if k == name), "") or ""


def markup(events: list[tuple], drop: frozenset[int] | set[int] = frozenset(), first: int = 0) -> str:
    """Events as HTML again, values as they were decoded."""
    out = []
    for i, (kind, name, attrs) in enumerate(events, first):
        if i in drop:
            continue
        if kind == TEXT:
            out.append(name)
        elif kind == END:
            out.append(f"</{name}>")
        else:
            out.append("<" + " ".join([name, *(k if v is None else f'{k}="{v}"' for k, v in attrs)]) + ">")
    return "".join(out)


def tidy(raw: str) -> str:
    """Decode what references are left; one blank for white space within
    blocks, one empty line between them."""
    parts = (" ".join(b.split()) for b in re.sub(r"\n{3,}", "\n\n", entities.unescape(raw)).split("\n\n"))
    return "\n\n".join(b for b in parts if b)


def text_of(events: list[tuple]) -> str:
    out, silent = [], False
    for kind, name, _ in events:
        if kind == TEXT:
            if not silent:
                out.append(name)
        elif name in ("script", "style"):
            silent = kind == START
        elif kind == END and not silent and name in BLOCK_TAGS:
            out.append("\n\n")
    return tidy("".join(out))


def _rank(tag: str, attrs: list) -> int:
    for i, (want, attr, value) in enumerate(MAIN_PLACES):
        if tag == want and (attr is None or (value in _attr(attrs, attr).split() if attr == "class" else _attr(attrs, attr) == value)):
            return i
    return len(MAIN_PLACES)


def _closing(events: list[tuple], at: int) -> int | None:
    """Where the element opened at ``at`` closes, counting its own tag alone."""
    depth, tag = 0, events[at][1]
    for i in range(at + 1, len(events)):
        if events[i][1] == tag and events[i][0] != TEXT:
            depth += 1 if events[i][0] == START else -1
            if depth < 0:
                return i
    return None


def main_by_place(events: list[tuple]) -> str | None:
    """Inner HTML of the best-placed container.  Containers within one that is
    being read are not looked at; one that never closes ends the search."""
    best, found, i = len(MAIN_PLACES), None, 0
    while i < len(events):
        kind, tag, attrs = events[i]
        rank = _rank(tag, attrs) if kind == START else best
        if rank < best:
            end = _closing(events, i)
            if end is None:
                break
            best, found, i = rank, markup(events[i + 1 : end]), end
        i += 1
    return found


@dataclass
class _Block:
    at: int
    tag: str
    words: int = 0
    links: int = 0
    nav: bool = False


def main_by_density(events: list[tuple]) -> str | None:
    """Inner HTML of the div or section with most words, less three a link and
    fifty where navigation lies directly in it; above fifty only, first of
    equals in closing order."""
    open_: list[_Block] = []
    stray: set[int] = set()
    best, span = LEAST_DENSITY, None
    for i, (kind, name, _) in enumerate(events):
        if kind == TEXT:
            n = len(name.split())
            for b in open_:
                b.words += n
        elif kind == START:
            if name in DENSE_TAGS:
                open_.append(_Block(i, name))
            elif name == "a":
                for b in open_:
                    b.links += 1
            elif name in NAV_TAGS and open_:
                open_[-1].nav = True
        elif name in DENSE_TAGS:
            mine = next((b for b in reversed(open_) if b.tag == name), None)
            if mine is None:
                stray.add(i)
                continue
            open_.remove(mine)
            score = mine.words - LINK_COST * mine.links - NAV_COST * mine.nav
            if score > best:
                best, span = score, (mine.at + 1, i)
    return None if span is None else markup(events[span[0] : span[1]], stray, span[0])


def _boilerplate(tag: str, attrs: list) -> bool:
    own = _attr(attrs, "id")
    return tag in BOILERPLATE_TAGS or any(x in c for c in _attr(attrs, "class").split() for x in BOILERPLATE_CLASSES) or any(x in own for x in BOILERPLATE_IDS)


def without_boilerplate(events: list[tuple]) -> str:
    """HTML without boilerplate elements; one that never closes takes the rest along."""
    keep, i = [], 0
    while i < len(events):
        kind, tag, attrs = events[i]
        if kind == START and _boilerplate(tag, attrs):
            end = _closing(events, i)
            if end is None:
                break
            i = end
        else:
            keep.append(events[i])
        i += 1
    return markup(keep)


def extract_content(page: str | None) -> str:
    """Main content as HTML: by place, else by density, else the whole page."""
    if not page or not page.strip():
        return ""
    events = tape_of(page)
    chosen = main_by_place(events)
    if chosen is None:
        chosen = main_by_density(events)
    return without_boilerplate(events if chosen is None else tape_of(chosen))


def strip_html(page: str | None) -> str:
    return text_of(tape_of(page or ""))


def headings_of(events: list[tuple]) -> tuple[str, list[tuple[int, str, int]]]:
    """Text, and (level, text, offset) of each heading with text.  Offsets
    count the characters before white space is tidied, at the heading's end."""
    out, found, at, silent, level, parts = [], [], 0, 0, 0, []
    for kind, name, _ in events:
        if kind != TEXT and name in SILENT_TAGS:
            silent = silent + 1 if kind == START else max(0, silent - 1)
        elif silent:
            continue
        elif kind == TEXT:
            out.append(name)
            at += len(name)
            if level:
                parts.append(name)
        else:
            is_heading = len(name) == 2 and name[0] == "h" and name[1] in "123456"
            if is_heading and kind == START:
                level, parts = int(name[1]), []
            elif is_heading and level:
                title = " ".join("".join(parts).split())
                if title:
                    found.append((level, title, at))
                level = 0
            if kind == END and name in BLOCK_TAGS:
                out.append("\n\n")
                at += 2
    return tidy("".join(out)), found


def anchors_of(events: list[tuple]) -> list[tuple[str, str]]:
    """(href, visible text) of each closed anchor; one without a value is none."""
    found, href, parts = [], None, []
    for kind, name, attrs in events:
        if kind == TEXT:
            if href is not None:
                parts.append(name)
        elif name == "a":
            if kind == START:
                href, parts = dict(attrs).get("href", ""), []
            elif href is not None:
                found.append((href, "".join(parts)))
                href = None
    return found


def resolve_link(href: str, source: str) -> tuple[str, str] | None:
    """(target, anchor) within the tree, or None for external and empty links.
    Directory indexes lose their file name."""
    if not href or href.startswith(("#", *EXTERNAL)):
        return None
    path, mark, rest = href.partition("#")
    target = posixpath.normpath(posixpath.join(posixpath.dirname(source), path))
    target = target.removeprefix("./").removesuffix("/index.html")
    return None if target in ("", "index.html") else (target, mark + rest)


def links_of(events: list[tuple], source: str) -> list[tuple[str, str, str]]:
    """(target, anchor, text) of each internal link, in order."""
    out = []
    for href, label in anchors_of(events):
        found = resolve_link(href, source)
        if found is not None:
            out.append((*found, label.strip()))
    return out


def shell_of(events: list[tuple]) -> tuple[int, bool]:
    """Characters of text in the body (scripts counted), and whether it has an
    application's root element."""
    size, inside, root, pieces = 0, False, False, 0
    for kind, name, attrs in events:
        if kind == TEXT:
            t = name.strip()
            if inside and t:
                size, pieces = size + len(t), pieces + 1
        elif name == "body":
            inside = kind == START
        elif kind == START and inside and name == "div" and any(k == "id" and v in SHELL_IDS for k, v in attrs):
            root = True
    return size + max(0, pieces - 1), root


#: What is read off a page that the parser gives up on.
FAILED = {"text": "", "raw_words": 0, "extracted_words": 0, "headings": [], "links": [], "body_chars": 0, "app_root": False, "failed": True}

PARSED = "text string, raw_words long, extracted_words long, headings array<struct<level: int, text: string, char_offset: int>>, links array<struct<ord: int, target_path: string, anchor: string, link_text: string>>, body_chars long, app_root boolean, failed boolean"
_HEADINGS = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("char_offset", pa.int32())]))
_LINKS = pa.list_(pa.struct([("ord", pa.int32()), ("target_path", pa.string()), ("anchor", pa.string()), ("link_text", pa.string())]))


def parse_page(page: str | None, path: str, extract: bool = True) -> dict:
    """All that the engine reads off a page."""
    events = tape_of(page or "")
    raw = text_of(events)
    main = extract_content(page) if extract else (page or "")
    tape = tape_of(main) if extract else events
    text = text_of(tape)
    _, heads = headings_of(tape)
    size, root = shell_of(events)
    return {
        "text": text,
        "raw_words": len(raw.split()),
        "extracted_words": len(text.split()),
        "headings": [{"level": a, "text": b, "char_offset": c} for a, b, c in heads],
        "links": [{"ord": i, "target_path": t, "anchor": a, "link_text": x} for i, (t, a, x) in enumerate(links_of(events, path))],
        "body_chars": size,
        "app_root": root,
        "failed": False,
    }


def parse_or_fail(page: str | None, path: str, extract: bool = True) -> dict:
    """As parse_page; a page that cannot be parsed is empty and marked."""
    try:
        return parse_page(page, path, extract)
    except (AssertionError, ValueError, IndexError, RecursionError):  # what html.parser raises on broken declarations
        return FAILED


def parse_pages(files: DataFrame, extract: bool = True, path: str = "rel_path", content: str = "content") -> DataFrame:
    """Columns of ``files`` but the content, with PARSED; one parse per page, in
    Arrow batches.  Null content is an empty page; one that cannot be parsed is
    empty and ``failed``, and stops nothing."""
    keep = [c for c in files.columns if c != content]
    types = dict(files.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", " + PARSED
    kinds = {"text": pa.string(), "raw_words": pa.int64(), "extracted_words": pa.int64(), "headings": _HEADINGS, "links": _LINKS, "body_chars": pa.int64(), "app_root": pa.bool_(), "failed": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 128):
                part = b.slice(lo, 128)
                rows = [parse_or_fail(page, p or "", extract) for page, p in zip(part.column(content).to_pylist(), part.column(path).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array([r[k] for r in rows], t) for k, t in kinds.items()]], names=[*keep, *kinds])

    return files.select(*keep, content).mapInArrow(run, schema)


def register(spark: SparkSession) -> None:
    """strip_html and extract_content as SQL functions; empty for a page that
    cannot be parsed."""
    def tolerant(read):
        def one(page: str | None) -> str:
            try:
                return read(page)
            except (AssertionError, ValueError, IndexError, RecursionError):
                return ""

        return one

    @F.pandas_udf("string")
    def strip(pages: pd.Series) -> pd.Series:
        return pages.map(tolerant(strip_html))

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(tolerant(extract_content))

    spark.udf.register("strip_html", strip)
    spark.udf.register("extract_content", extract)
