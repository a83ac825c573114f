"""Text, path and URL functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it; Java's \s is narrower.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
MIN_BLOCK_WORDS = 10
SHINGLE = 3

# Suffixes of files that are never read as text.
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp", ".tiff",
    ".pdf", ".zip", ".gz", ".tar", ".bz2", ".7z", ".rar",
    ".mp4", ".webm", ".mov", ".avi", ".mp3", ".wav", ".ogg",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".exe", ".dmg", ".bin", ".wasm", ".so", ".dll",
)


def squeezed(text: Column) -> Column:
    """White space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def squeezed_words(text: Column) -> Column:
    """Words of a squeezed text, by the blanks between them; null: 0."""
    n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + (text != "").cast("int")
    return F.coalesce(n, F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    """Words of the text; null: 0.  The blanks are counted, as a negated class
    that matches nearly every character costs Java seven times as much."""
    return squeezed_words(squeezed(text))


def trimmed(text: Column) -> Column:
    return F.regexp_extract(text, f"(?s)[^{SPACE}](?:.*[^{SPACE}])?", 0)


def normalised(text: Column) -> Column:
    """Lower case, white space runs to one blank, trimmed."""
    return squeezed(F.lower(text))


def blocks(text: Column, delimiter: str = "\n\n") -> Column:
    """Trimmed, non-empty parts of the text."""
    parts = F.split(text, "\\Q" + delimiter + "\\E")
    return F.filter(F.transform(parts, trimmed), lambda b: b != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def md5_long(text: Column) -> Column:
    """First eight bytes of the MD5, big-endian, as a signed long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: an expression that a lambda
    refers to would be worked out anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column) -> Column:
    """Runs of three words; a shorter text is one shingle, as it is."""
    whole = F.array(text)
    return let(words(text), lambda w: F.when(F.size(w) < SHINGLE, whole).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (SHINGLE - 1))), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))))


def simhash64(text: Column) -> Column:
    """SimHash of the text's three-word shingles: a bit is set where more
    hashes have it than not.  An expression, for a few rows; tables go through
    operators.dedup.simhash."""

    def vote(h: Column) -> Column:
        def bit(i: Column) -> Column:
            ones = F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: acc + F.call_function("shiftrightunsigned", x, i).bitwiseAND(F.lit(1)))
            return F.when(ones * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(bit(i)))

    return let(F.transform(shingles(text), md5_long), vote)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def boundary_integrity(text: Column) -> Column:
    """Code fences and <pre> elements are all closed."""
    fences = F.regexp_count(text, F.lit("```")) % 2 == 0
    opened = F.regexp_count(text, F.lit(f"(?i)<pre[{SPACE}>]"))
    return F.coalesce(fences & (opened == F.regexp_count(text, F.lit("(?i)</pre>"))), F.lit(True))


def suffix(path: Column) -> Column:
    """Lower-cased last suffix of the file name, with its dot; a leading dot is none."""
    return F.lower(F.regexp_extract(path, r"(?s)(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1))


def is_binary(path: Column) -> Column:
    return suffix(path).isin(*BINARY_EXTENSIONS)


def is_html(path: Column) -> Column:
    return F.lower(path).rlike(r"\.html?$")


def module_of(path: Column) -> Column:
    """The file's directory, ``_`` at the top."""
    d = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit("_")).otherwise(d)


def chunk_id(index: Column, prefix: str = "docs_chunk_") -> Column:
    return F.format_string("%s%02d", F.lit(prefix), index)


def short_path(path: Column, most: int = 40) -> Column:
    return F.when(F.length(path) > most, F.concat(F.lit("..."), F.right(path, F.lit(most - 3)))).otherwise(path)


# -- URLs ------------------------------------------------------------------


def url_part(url: Column, part: int) -> Column:
    """1 scheme, 2 host and port, 3 path; empty where absent."""
    return F.regexp_extract(url, r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#;]*)", part)


def canonical_prefix(path: Column) -> Column:
    return F.concat(F.rtrim(path, F.lit("/")), F.lit("/"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def in_scope(url: Column, base: Column, depth: int = 0) -> Column:
    """http(s), the base's host, below its path, at most ``depth`` segments
    deeper (0: any)."""
    here = canonical_prefix(url_part(url, 3))
    ok = F.lower(url_part(url, 1)).isin("http", "https") & (url_part(url, 2) == url_part(base, 2)) & F.startswith(here, canonical_prefix(url_part(base, 3)))
    ok = ok & (url_part(base, 1) != "") & (url_part(base, 2) != "")
    if depth > 0:
        ok = ok & (F.size(segments(url_part(url, 3))) - F.size(segments(url_part(base, 3))) <= depth)
    return ok


def noise_ratio(raw: Column, extracted: Column) -> Column:
    """Share of the raw words that extraction removed, between 0 and 1."""
    return F.when(raw <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - extracted / raw)))


def readiness(noise: Column, boundary: Column, depth: Column) -> Column:
    """0.4 for little noise, 0.3 for whole boundaries, up to 0.3 for headings."""
    deep = F.when(depth <= 0, F.lit(0.0)).when(depth == 1, F.lit(0.5)).otherwise(F.lit(1.0))
    return F.lit(0.4) * (1 - noise) + F.lit(0.3) * boundary.cast("double") + F.lit(0.3) * deep


def half_even(x: Column, digits: int) -> Column:
    """Rounded as SQL's round_even: of the scaled double, halves to the even
    side.  The shortest decimal, as ``bround`` has it, sees 0.8250000000000001,
    where sums of binary fractions mean 0.825, as no half."""
    return F.rint(x * 10**digits) / 10**digits


def grade(score: Column) -> Column:
    return F.when(score >= 0.8, "A").when(score >= 0.5, "B").otherwise("C")
