"""Benchmark text in training documents, found by a positional inverted index.
DataFrame expressions only.

Documents are cut into words once, in a durable table; a long text is several
rows, each with the first words of what follows, so that whatever begins in a
row ends in it.  The corpus frequency of every benchmark word tells the rarest
words of each window; for those the index keeps where they stand (word, row,
position).  Positions less the word's place in the item are alike where a whole
window occurs, so lists are intersected by (row, item, difference), rarest
words first, and what is left is compared with the document's words.

A frequent word costs rows only where it is among the rarest of a window.
Tables go to every task only below a stated size (``SMALL_ROWS``,
``SMALL_BYTES``, both counted first); larger ones are joined by key, words in
salted parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable

#: ASCII other than letters and digits parts words; letters of both cases are taken, then A-Z lowered.
_PART, _IN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a text that are one row; longer ones are cut at the next end of a word.
SLICE = 1 << 16
#: What a table may have at most to go to every task, and parts that a word's rows are joined in beyond that.
SMALL_ROWS, SMALL_BYTES, SALTS = 500_000, 16 << 20, 16


def _lowered(text: Column) -> Column:
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{_IN}+"), F.lit(0))


def tokenised(docs: DataFrame, tail: int, keep: tuple[str, ...] = ("doc_id",), slice_chars: int = SLICE) -> DataFrame:
    """The words of every whole text as a durable table: ``keep`` columns in a
    struct, _row (the document), _piece (this row), start (words of the document
    before it), n (words that begin in it), words (those, then up to ``tail`` that
    follow) and, on a document's first row alone, n_words.  A document without
    words has one row."""
    low = docs.select(F.struct(*keep).alias("keep"), F.monotonically_increasing_id().alias("_row"), _lowered(F.col("text")).alias("_text"))
    cut = F.regexp_extract_all("_text", F.lit(f"(?s).{{{slice_chars}}}{_IN}*|.+"), F.lit(0))
    pieces = F.when(F.length("_text") <= slice_chars, F.array("_text")).otherwise(F.filter(cut, lambda p: p.rlike(_IN)))
    low = low.select("keep", "_row", pieces.alias("_pieces"))
    low = low.withColumn("_counts", F.when(F.size("_pieces") > 1, F.transform("_pieces", lambda p: F.regexp_count(p, F.lit(f"{_IN}+")))))
    at = low.select("keep", "_row", "_pieces", "_counts", F.posexplode_outer("_pieces").alias("_k", "_piece_text"))
    at = at.withColumn("_k", F.coalesce("_k", F.lit(0)))

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    several = F.coalesce(F.size("_pieces") > 1, F.lit(False))
    rest = F.array_join(F.slice("_pieces", F.col("_k") + 2, tail), " ")
    more = F.regexp_extract(rest, f"^(?:{_PART}*{_IN}+){{1,{tail}}}", 0) if tail else F.lit("")
    text = F.when(several & (F.col("_k") + 1 < F.size("_pieces")), F.concat("_piece_text", F.lit(" "), more)).otherwise(F.coalesce("_piece_text", F.lit("")))
    start = F.when(several, total(F.slice("_counts", 1, F.col("_k")))).otherwise(F.lit(0).cast("long"))
    rows = at.select("keep", "_row", "_k", start.alias("start"), F.when(several, F.element_at("_counts", F.col("_k") + 1)).alias("_own"), F.when(several, total(F.col("_counts"))).alias("_all"), _words(text).alias("words"))
    n = F.coalesce("_own", F.size("words")).cast("long")
    rows = rows.select("keep", "_row", F.monotonically_increasing_id().alias("_piece"), "start", n.alias("n"), "words", F.when(F.col("_k") == 0, F.coalesce("_all", n)).alias("n_words"))
    return durable(rows, "leak-words")


def _small(table: DataFrame, *texts: str) -> bool:
    size = reduce(lambda a, b: a + b, [F.octet_length(c) for c in texts], F.lit(0))
    n, held = table.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return n <= SMALL_ROWS and held <= SMALL_BYTES


def _by_word(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows joined with a table by ``word``: sent to every task if it is small,
    else in salted parts."""
    if _small(table, "word"):
        return rows.join(F.broadcast(table), "word")
    parts = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_piece", "at"), F.lit(SALTS)).cast("int")).join(parts, ["word", "_salt"]).drop("_salt")


def _frequencies(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, f): how often the corpus has each of the terms."""
    own = F.when(F.size("words") == F.col("n"), F.col("words")).otherwise(F.slice("words", 1, F.col("n").cast("int")))
    seen = tokens.select(F.explode(own).alias("word"))
    if _small(terms, "word"):
        seen = seen.join(F.broadcast(terms), "word", "left_semi")
        return durable(seen.groupBy("word").agg(F.count("*").alias("f")), "leak-frequencies")
    return durable(seen.groupBy("word").agg(F.count("*").alias("f")).join(terms, "word", "left_semi"), "leak-frequencies")


def _phrases(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct word lists (pid, words) of items with words, and (pid, item_id)."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), _words(_lowered(F.coalesce("text", F.lit("")))).alias("words")).where(F.size("words") > 0)
    cut = durable(cut, "leak-items")
    phrases = durable(cut.select("words").distinct().withColumn("pid", F.monotonically_increasing_id()), "leak-phrases")
    return phrases, durable(cut.join(phrases, "words").where(F.col("item_id").isNotNull()).select("pid", "item_id").distinct(), "leak-ids")


def _terms(phrases: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pid, at, word, f) of every word of the phrases."""
    placed = durable(phrases.select("pid", F.posexplode("words").alias("at", "word")), "leak-terms")
    f = _frequencies(tokens, placed.select("word").distinct())
    return placed.join(f, "word", "left").select("pid", "at", "word", F.coalesce("f", F.lit(0)).cast("long").alias("f"))


def _rarest(found: Column) -> Column:
    """The rarest of (f, word, at), then the rarest of another word, else of the same."""
    others = F.filter(found, lambda x: x["word"] != found[0]["word"])
    second = F.when(F.size(others) > 0, F.slice(others, 1, 1)).otherwise(F.slice(found, 2, 1))
    return F.concat(F.slice(found, 1, 1), second)


def windows_of(phrases: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """Every window of ``n`` words, or a shorter phrase whole, that can occur:
    (pid, at, win, need), where ``need`` has its two rarest (f, word, at)."""
    frame = W.partitionBy("pid").orderBy("at").rowsBetween(0, n - 1)
    ranked = terms.withColumn("_found", F.array_sort(F.collect_list(F.struct("f", "word", "at")).over(frame)))
    starts = phrases.select("pid", F.size("words").alias("_size"), "words")
    rows = ranked.join(starts, "pid").where((F.col("at") == 0) | (F.col("at") + n <= F.col("_size")))
    rows = rows.where(F.col("_found")[0]["f"] > 0)
    return durable(rows.select("pid", "at", F.slice("words", F.col("at") + 1, n).alias("win"), _rarest(F.col("_found")).alias("need")), "leak-windows")


def postings(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """The index: (word, _piece, at) wherever one of ``words`` stands."""
    placed = tokens.select("_piece", F.posexplode("words").alias("at", "word"))
    return durable(_by_word(placed, words), "leak-postings")


def phrase_matches(tokens: DataFrame, phrases: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(_row, start, length, pid): every place where a window of a phrase
    occurs.  ``tokens`` must have a tail of n - 1 words at least."""
    windows = windows_of(phrases, terms, n)
    picked = windows.select("pid", F.size("need").alias("_least"), F.explode("need").alias("x")).groupBy(F.col("x.word").alias("word"), "pid", F.col("x.at").alias("own")).agg(F.min("_least").alias("_least"))
    picked = durable(picked, "leak-picked")
    index = postings(tokens, picked.select("word").distinct())
    placed = _by_word(index, picked)
    lists = placed.groupBy("_piece", "pid", (F.col("at") - F.col("own")).alias("shift")).agg(F.collect_set("own").alias("got"), F.min("_least").alias("_least"))
    lists = lists.where(F.size("got") >= F.col("_least"))
    # every window whose rarest words stand where they should
    maybe = lists.join(windows.select("pid", F.col("at").alias("_at"), "win", F.transform("need", lambda x: x["at"]).alias("need")), "pid")
    maybe = maybe.where((F.size(F.array_except("need", "got")) == 0) & (F.col("shift") + F.col("_at") >= 0))
    maybe = durable(maybe.select("_piece", (F.col("shift") + F.col("_at")).alias("at"), "pid", "win"), "leak-candidates")
    there = maybe.select("_piece").distinct()
    held = tokens.select("_row", "_piece", "start", "n", "words")
    held = held.join(F.broadcast(there), "_piece", "left_semi") if _small(there) else held.join(there, "_piece", "left_semi")
    found = held.join(maybe, "_piece").where((F.col("at") < F.col("n")) & (F.slice("words", F.col("at") + 1, F.size("win")) == F.col("win")))
    return durable(found.select("_row", (F.col("start") + F.col("at")).alias("start"), F.size("win").alias("length"), "pid"), "leak-matches")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, item_id, at, first, last: every place ``at`` of an
    item's rarest word (in the corpus, then by code point) around which all its
    distinct words occur at most ``slop`` words away, in any order, and the
    places of the first and last of them within that distance.

    Texts and items without words match nothing; repeated rows are documents of
    their own; items of one text match alike; an item without id is left out.
    Long texts are searched whole.  ``keep`` may not name a column of the result."""
    if taken := sorted({"item_id", "at", "first", "last"} & {*keep}):
        raise ValueError(f"columns of the result: {', '.join(taken)}")
    tokens = tokenised(docs, 2 * slop, keep)
    phrases, ids = _phrases(items)
    terms = _terms(phrases, tokens).groupBy("pid", "word").agg(F.first("f").alias("f"))
    needed = terms.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("f", "word"))).alias("need")).where(F.col("need")[0]["f"] > 0)
    needed = durable(needed.select("pid", F.transform("need", lambda x: x["word"]).alias("need")), "leak-needed")
    lead = needed.select(F.col("need")[0].alias("word"), "pid", F.lit(0).alias("_role")).unionByName(needed.where(F.size("need") > 1).select(F.col("need")[1].alias("word"), "pid", F.lit(1).alias("_role")))
    lead = durable(lead, "leak-picked")
    index = postings(tokens, lead.select("word").distinct())
    placed = durable(_by_word(index, lead).select("_piece", "pid", "_role", "at"), "leak-placed")
    one, two = placed.where("_role = 0").select("_piece", "pid", "at"), placed.where("_role = 1")
    near = two.select("_piece", "pid", F.col("at").alias("_b"), F.explode(F.array(*[F.floor(F.col("at") / (slop + 1)).cast("int") + d for d in (-1, 0, 1)])).alias("_bucket"))
    both = one.withColumn("_bucket", F.floor(F.col("at") / (slop + 1)).cast("int")).join(near, ["_piece", "pid", "_bucket"]).where(F.abs(F.col("at") - F.col("_b")) <= slop).select("_piece", "pid", "at").distinct()
    single = one.join(needed.where(F.size("need") == 1).select("pid"), "pid", "left_semi").select("_piece", "pid", "at")
    maybe = durable(both.unionByName(single), "leak-candidates").join(needed, "pid")
    # a place belongs to the row that has what stands before it
    mine = (F.col("at") < F.col("n") + slop) & ((F.col("start") == 0) | (F.col("at") >= slop))
    held = tokens.join(maybe, "_piece").where(mine)
    lo = F.greatest(F.lit(0), F.col("at") - slop)
    held = held.withColumn("_lo", lo).withColumn("_near", F.slice("words", lo + 1, F.col("at") - lo + slop + 1))
    held = held.where(F.forall("need", lambda w: F.array_contains(F.col("_near"), w)))
    hits = F.filter(F.transform("_near", lambda w, i: F.when(F.array_contains(F.col("need"), w), i)), lambda i: i.isNotNull())
    out = held.withColumn("_hits", hits).join(ids, "pid")
    base = F.col("start") + F.col("_lo")
    return out.select("keep.*", "item_id", (F.col("start") + F.col("at")).alias("at"), (base + F.array_min("_hits")).alias("first"), (base + F.array_max("_hits")).alias("last"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, keep: tuple[str, ...] = ("doc_id",), slice_chars: int = SLICE) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with n_words, n_hit (words
    inside any occurrence of a window), n_items (items with windows that occur),
    items_sha256 (of their ids, as strings, sorted, parted by commas) and
    contaminated (n_hit > 0).  ``items`` are (item_id, text); a window is ``n``
    consecutive words, or all words of an item that has fewer.

    A null or empty text has no words, is clean and has the hash of no ids.  An
    item without words has no window.  Rows that repeat or share an id, or have
    none, are documents of their own.  Items of one text, and rows that share an
    item_id, count by id; a row without item_id marks words but is not named.
    Overlapping windows count a word once.  Texts are searched whole, in rows of
    ``slice_chars`` characters; no word or window is cut.  Empty tables are
    allowed.  Other columns are not read; ``keep`` may not name a column of the
    result."""
    if taken := sorted({"n_words", "n_hit", "n_items", "items_sha256", "contaminated"} & {*keep}):
        raise ValueError(f"columns of the result: {', '.join(taken)}")
    tokens = tokenised(docs, n - 1, keep, slice_chars)
    phrases, ids = _phrases(items)
    matches = phrase_matches(tokens, phrases, _terms(phrases, tokens), n)
    spans = matches.groupBy("_row", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(W.partitionBy("_row").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest("start", F.coalesce(before, "start"))))
    hits = spans.groupBy("_row").agg(F.sum("_new").alias("n_hit"))
    named = matches.select("_row", "pid").distinct().join(ids, "pid").select("_row", "item_id").distinct()
    named = named.groupBy("_row").agg(F.sort_array(F.collect_list("item_id")).alias("_ids"))
    rows = tokens.where(F.col("n_words").isNotNull()).select("keep", "_row", "n_words").join(hits, "_row", "left").join(named, "_row", "left")
    zero = F.lit(0).cast("long")
    found = F.coalesce("_ids", F.array().cast("array<string>"))
    return rows.select("keep.*", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", zero).alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))
