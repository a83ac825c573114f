"""Language-model scoring by prediction by partial matching over bytes.

A text is its tokens: words (runs of anything but ASCII white space, A-Z
lower-cased) and one end.  The model spells each word byte by byte and closes
it; contexts are the symbols since the text's start, at most ``order`` of them,
across the ends of words.
The trie has the counts of each symbol after each context.  Where a symbol is
new in a context the model escapes (method C: as often as the context has
shown new symbols) to the next shorter one and leaves out the symbols that the
longer one knows.  As every symbol known to a context is known to its suffix,
what is left out is a sum per context, so scoring is a few binary searches per
byte over sorted arrays, for all words of a batch at once.

Counts cover all training texts, at the full order whatever their number.  A
symbol's probability depends on itself and the ``order`` before it, its key.
The trie is a table of key counts in the shared folder.  Contexts longer than
``LOW`` are dealt by their last LOW + 1 symbols, so that a task has all that
concerns its keys; the shorter ones are a table bounded by the alphabet.
Workers read, from tables in the shared folder, the probabilities of about
``held`` common keys and the ``frequent`` commonest words; a text's other keys are sent to the task that has
their contexts, the other words' counts are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh_path, grouped, holds, read_parts, read_table, release, shuffle_partitions, sliced, turn_to

#: Symbols: bytes, the end of a word (and, in contexts, its start), the end of the text.
CLOSE, END, SYMBOLS = 256, 257, 258
_U = np.uint64
_B = 9  # bits of a symbol
#: Contexts of at most so many symbols are held whole.
LOW = 2
#: Keys of a task, as a rule; symbols counted at once; words of a long text that are spelled at once.
TASK_KEYS, CHUNK, PIECE = 500_000, 4_000_000, 1 << 17
#: Words of all texts for a part of the counts, as a rule; keys and counts sent or summed at once; parts at most.
PART_WORDS, STEP, PARTS = 1_000_000, 1 << 19, 1 << 14
_SYMBOL = np.arange(256, dtype=_U)
_SYMBOL[[32, 10]] = CLOSE, END  # no word has white space


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of the words (b'' stands for the end of the text), each
    one's place in its word, and its word."""
    size = np.array([len(w) + 1 for w in words], "int64")
    total = int(size.sum())
    flat = np.full(total, CLOSE, _U)
    ends = np.cumsum(size) - 1
    inner = np.ones(total, bool)
    inner[ends] = False
    flat[inner] = np.frombuffer(b"".join(words), "uint8")
    flat[ends[size == 1]] = END
    return flat, np.arange(total) - np.repeat(ends + 1 - size, size), np.repeat(np.arange(len(words)), size)


def _keys(flat: np.ndarray, pos: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The symbol and the ``order`` before it, packed; before the word: CLOSE."""
    k = flat[at].copy()
    for j in range(1, order + 1):
        k |= np.where(pos[at] >= j, flat[np.maximum(at - j, 0)], _U(CLOSE)) << _U(_B * j)
    return k


def stream_keys(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all symbols of the texts (tokens each), contexts crossing the
    ends of words but not of texts, and where each text starts."""
    pad = b" " * order
    parts = [pad + b"".join([w + b" " for w in words]) + b"\n" for words in texts]
    flat = _SYMBOL[np.frombuffer(b"".join(parts), "uint8")]
    size = np.fromiter(map(len, parts), "int64", len(parts))
    k = flat.copy()
    for j in range(1, order + 1):
        k[j:] |= flat[:-j] << _U(_B * j)
    real = np.ones(len(flat), bool)
    starts = np.cumsum(size) - size
    real[(starts[:, None] + np.arange(order)).ravel()] = False
    return k[real], starts - order * np.arange(len(parts))


def _group_keys(texts: list[str | None], order: int) -> Iterator[np.ndarray]:
    """Keys of the texts, in arrays of bounded size for a long text on its own."""
    if len(texts) > 1:
        yield stream_keys([tokens(t) for t in texts], order)[0]
        return
    words = tokens(texts[0])
    for lo in range(0, max(1, len(words)), PIECE):
        before = words[max(0, lo - order) : lo]  # at least ``order`` symbols, where there are
        k = stream_keys([before + words[lo : lo + PIECE]], order)[0]
        yield k[sum(map(len, before)) + len(before) : None if lo + PIECE >= len(words) else -1]


def _real(keys: np.ndarray, d: int) -> np.ndarray:
    """Keys with a context as long as d: the d-th symbol back is the start at most."""
    if d < 2:
        return np.ones(len(keys), bool)
    return (((keys >> _U(_B * d)) & _U(511)) != CLOSE) | (((keys >> _U(_B * (d - 1))) & _U(511)) != CLOSE)


def _tables(keys: np.ndarray, counts: np.ndarray, order: int, low: list[dict[str, np.ndarray]] | None = None) -> list[dict[str, np.ndarray]]:
    """Per order: sorted (context, symbol) keys and counts; contexts, their
    totals and numbers of symbols; and both of the suffix, less what is known
    here.  The first orders are ``low``, where it is given."""
    out: list[dict[str, np.ndarray]] = list(low or [])
    for d in range(len(out), order + 1):
        real = _real(keys, d)
        u, inv = np.unique(keys[real] & _U((1 << _B * (d + 1)) - 1), return_inverse=True)
        c = np.bincount(inv, weights=counts[real], minlength=len(u))
        context, first = np.unique(u >> _U(_B), return_index=True)
        n, q = np.add.reduceat(c, first) if len(u) else np.empty(0), np.diff(np.r_[first, len(u)]).astype(float)
        t = {"key": u, "count": c, "context": context, "n": n, "q": q, "nx": np.zeros(len(context)), "qx": np.zeros(len(context))}
        if d and len(u):
            low = out[d - 1]
            known = np.add.reduceat(low["count"][np.searchsorted(low["key"], u & _U((1 << _B * d) - 1))], first)
            up = np.searchsorted(low["context"], context & _U((1 << _B * (d - 1)) - 1))
            t["nx"], t["qx"] = low["n"][up] - known, low["q"][up] - q
        out.append(t)
    return out


class Trie:
    """A pretrained model in one process: log10 probabilities of spelled words,
    each on its own."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.tables = order, _tables(keys, counts, order)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Of each word with its close; b'' is the end of the text."""
        if not words:
            return np.empty(0)
        flat, pos, own = _spelled(words)
        return np.bincount(own, weights=self._symbols(flat, pos), minlength=len(words))

    def _symbols(self, flat: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return costs(self.tables, _keys(flat, pos, np.arange(len(flat)), self.order), self.order)


def costs(tables: list[dict[str, np.ndarray]], keys: np.ndarray, order: int) -> np.ndarray:
    """log10 probabilities of the keys' symbols after their contexts."""
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    left_n, left_q = np.full(len(keys), -1.0), np.zeros(len(keys))  # after an escape: what the next context has besides
    for d in range(order, -1, -1):
        at, t = np.flatnonzero(open_ & _real(keys, d)), tables[d]
        if not len(at) or not len(t["key"]):
            continue
        k = keys[at] & _U((1 << _B * (d + 1)) - 1)
        e = np.minimum(np.searchsorted(t["key"], k), len(t["key"]) - 1)
        c = np.minimum(np.searchsorted(t["context"], k >> _U(_B)), len(t["context"]) - 1)
        known = t["context"][c] == k >> _U(_B)
        hit = t["key"][e] == k
        came = left_n[at] >= 0
        n, q = np.where(came, left_n[at], t["n"][c]), np.where(came, left_q[at], t["q"][c])
        out[at[hit]] += np.log10(t["count"][e[hit]] / (n[hit] + q[hit]))
        open_[at[hit]] = False
        miss = known & ~hit
        pays = miss & (q > 0)  # a context with nothing besides is passed for free
        out[at[pays]] += np.log10(q[pays] / (n[pays] + q[pays]))
        left_n[at[miss]], left_q[at[miss]] = t["nx"][c[miss]], t["qx"][c[miss]]
    out[open_] -= math.log10(max(1, SYMBOLS - len(tables[0]["key"])))
    return out


class Adaptive:
    """The same model, learning as it codes: code length of a text from an
    empty trie, or from what earlier texts have left in it."""

    def __init__(self, order: int = 6):
        self.order, self.nodes = order, {}

    def log10(self, text: str | None) -> float:
        total = 0.0
        past: tuple = (CLOSE,)
        for word in [*tokens(text), None]:
            spelled = [END] if word is None else [*word, CLOSE]
            for s in spelled:
                contexts = [past[len(past) - d :] for d in range(min(self.order, len(past)), -1, -1)]
                total += self._cost(contexts, s)
                for c in contexts:
                    node = self.nodes.setdefault(c, {})
                    node[s] = node.get(s, 0) + 1
                past = (*past, s)[-self.order :] if self.order else ()
        return total

    def _cost(self, contexts: list[tuple], s: int) -> float:
        total, gone = 0.0, set()
        for c in contexts:
            node = {k: n for k, n in self.nodes.get(c, {}).items() if k not in gone}
            if not node:
                continue
            n = sum(node.values()) + len(node)
            if s in node:
                return total + math.log10(node[s] / n)
            total += math.log10(len(node) / n)
            gone |= set(node)
        return total - math.log10(max(1, SYMBOLS - len(gone)))


def word_counts(texts: DataFrame, chunk: int = 2_000_000) -> DataFrame:
    """(word binary, c long) over the tokens of all texts, without the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("ppm-counts")
        seen: Counter = Counter()
        n = 0
        for texts, _ in grouped(batches, 256):
            for text in texts:
                words = tokens(text)
                seen.update(words)
                n += len(words)
                if n >= chunk:
                    yield from rows(seen)
                    seen, n = Counter(), 0
        yield from rows(seen)

    def rows(seen: Counter) -> Iterator[pa.RecordBatch]:
        words, n = list(seen), np.fromiter(seen.values(), "int64", len(seen))
        for lo in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 50_000], pa.binary()), pa.array(n[lo : lo + 50_000])], names=["word", "c"])

    return texts.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def adaptive(docs: DataFrame, order: int = 6) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text): the log10
    probability of the text by a model that starts empty and learns as it
    codes, so what repeats itself is short.  A null text is its end alone; rows
    that share an id are scored apart; an empty table stays empty.  A symbol at
    a time in Python: for selections, not for whole corpora."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([Adaptive(order).log10(t) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def train(words: DataFrame, ends: int, order: int = 6) -> Trie:
    """The trie of (word, c) and so many ends of texts, in this process, each
    word on its own: a small model for the caller.  ``score`` does not use it."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                flat, pos, own = _spelled(b.column("word").to_pylist())
                k, inv = np.unique(_keys(flat, pos, np.arange(len(flat)), order), return_inverse=True)
                n = np.bincount(inv, weights=b.column("c").to_numpy()[own])
                yield pa.RecordBatch.from_arrays([pa.array(k.view("int64")), pa.array(n.astype("int64"))], names=["k", "n"])

    top = durable(words.mapInArrow(grams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "ppm-entries", slim=True)
    got = top.toArrow()
    keys, counts = got.column("k").to_numpy().astype("int64").view(_U), got.column("n").to_numpy().astype("float64")
    if ends:
        flat, pos, _ = _spelled([b""])
        keys, counts = np.r_[keys, _keys(flat, pos, np.arange(1), order)], np.r_[counts, float(ends)]
    return Trie(keys, counts, order)


def key_counts(texts: DataFrame, order: int, words: int = 0) -> DataFrame:
    """(k, n): the keys of all texts and how often they occur, as a durable
    table.  Tasks send sorted keys and counts as arrays, one per part of the
    keys; a part's arrays are merged as they come.  The parts are more for
    more ``words``, and a key's hash tells its part, so that no context is more
    than its share of one."""
    parts_ = min(PARTS, max(shuffle_partitions(texts.sparkSession), words // PART_WORDS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("ppm-counts")
        yield from counted(batches)
        release()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(CHUNK, _U), 0
        for some, _ in grouped(batches, 256):
            for k in _group_keys(some, order):
                while len(k):
                    more = k[: CHUNK - size]
                    held[size : size + len(more)] = more
                    size, k = size + len(more), k[len(more) :]
                    if size == CHUNK:
                        yield from sent(held)
                        size = 0
        yield from sent(held[:size])

    def sent(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sorts the keys where they are."""
        keys.sort()
        starts = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]])
        for lo in range(0, len(starts), STEP):
            first = starts[lo : lo + STEP]
            k, n = keys[first], np.diff(np.r_[first, starts[lo + STEP] if lo + STEP < len(starts) else len(keys)]).astype("int32")
            part = _part(k, parts_)
            at = np.argsort(part, kind="stable")
            k, n, part = k[at], n[at], part[at]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[first[1:], len(k)].tolist()
            for i in range(0, len(first), 32):
                spans = list(zip(first[i : i + 32].tolist(), ends[i : i + 32], strict=True))
                blobs = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (k, n)]
                yield pa.RecordBatch.from_arrays([pa.array(part[first[i : i + 32]]), *blobs], names=["part", "k", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("ppm-counts")
        yield from merged(batches)
        release()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size, known = [], 0, 0
        for b in batches:
            for k, n in zip(b.column("k").to_pylist(), b.column("n").to_pylist(), strict=True):
                got.append((np.frombuffer(k, _U), np.frombuffer(n, "int32").astype("int64")))
                size += len(got[-1][0])
                if size - known >= max(STEP, known):
                    got = [_summed(got)]
                    size = known = len(got[0][0])
        if got:
            k, n = _summed(got)
            for lo in range(0, len(k), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[lo : lo + 50_000].view("int64")), pa.array(n[lo : lo + 50_000])], names=["k", "n"])

    dealt = texts.select("text").mapInArrow(count, "part int, k binary, n binary").repartitionById(parts_, F.col("part"))
    return durable(dealt.mapInArrow(merge, "k long, n long"), "ppm-entries", rows=64)  # arrays are long rows


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, by a hash of the whole key."""
    h = keys * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h >>= _U(33)
    h %= _U(parts)
    return h.astype("int32")


def _summed(got: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and the sums of their counts."""
    k, n = (np.concatenate(x) for x in zip(*got, strict=True))
    at = np.argsort(k)
    k, n = k[at], n[at]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(n, first)


def _least(rows: DataFrame, column: str, most: int) -> tuple[int, int]:
    """How many rows there are, and the least count that about ``most`` rows
    reach at most, by quarters of a power of two."""
    sizes = sorted(((r["b"], r["c"]) for r in rows.groupBy(F.floor(F.log2(column) * 4).alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True)
    so_far, least = 0, 1 << 62
    for b, c in sizes:
        so_far += c
        if so_far > most:
            break
        least = math.ceil(2 ** (b / 4) - 1e-9)
    return sum(c for _, c in sizes), least


def _low(entries: DataFrame, order: int) -> str:
    """A table of the keys and counts of the contexts of at most LOW symbols,
    which workers read; the alphabet bounds it."""
    uri = fresh_path(entries.sparkSession, "ppm-low")
    entries.groupBy(F.col("k").bitwiseAND(F.lit((1 << _B * (min(LOW, order) + 1)) - 1)).alias("k")).agg(F.sum("n").alias("n")).write.parquet(uri)
    return uri


@lru_cache(maxsize=1)
def _low_tables(uri: str, order: int) -> list[dict[str, np.ndarray]]:
    t = read_table(uri)
    return _tables(t.column("k").to_numpy().view(_U), t.column("n").to_numpy().astype("float64"), min(LOW, order))


@lru_cache(maxsize=1)
def _common(uri: str) -> tuple[dict[bytes, int], np.ndarray]:
    """Places and counts of the commonest words."""
    t = read_table(uri)
    return {w: i for i, w in enumerate(t.column("word").to_pylist())}, t.column("c").to_numpy()


def _dealt(rows: DataFrame, count: int) -> DataFrame:
    """Rows with a key, those of one context of LOW + 1 symbols in one task."""
    context = F.shiftright("k", _B).bitwiseAND(F.lit((1 << _B * (LOW + 1)) - 1))
    return rows.repartition(max(1, -(-count // TASK_KEYS)), context)


def _priced(entries: DataFrame, size: int, low: str, order: int, least: int) -> DataFrame:
    """(k, p): the log10 probabilities of the keys with at least ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("ppm-trie")
        got = [(b.column("k").to_numpy().view(_U), b.column("n").to_numpy()) for b in batches]
        if got:
            k, n = (np.concatenate(x) for x in zip(*got, strict=True))
            tables = _tables(k, n.astype("float64"), order, _low_tables(low, order))
            k = np.sort(k[n >= least])
            yield pa.RecordBatch.from_arrays([pa.array(k.view("int64")), pa.array(costs(tables, k, order))], names=["k", "p"])

    return _dealt(entries, size).mapInArrow(run, "k long, p double")


def _asked(entries: DataFrame, size: int, low: str, order: int, asked: DataFrame, most: int) -> DataFrame:
    """(row, p): sums of the log10 probabilities of the keys in ``asked`` (row, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("ppm-trie")
        got, tables, wait, size = [], None, [], 0
        for b in batches:
            row, k, n = (b.column(x).to_numpy() for x in ("row", "k", "n"))
            own = row < 0  # entries come first
            if own.any():
                got.append((k[own].view(_U), n[own]))
            if not own.all():
                wait.append((row[~own], k[~own].view(_U)))
                size += len(wait[-1][0])
            if size >= 200_000:
                tables = tables or built(got)
                yield sums(tables, wait)
                wait, size = [], 0
        if wait:
            yield sums(tables or built(got), wait)

    def built(got: list) -> list:
        k, n = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, _U), np.empty(0))
        return _tables(k, n.astype("float64"), order, _low_tables(low, order))

    def sums(tables: list, wait: list) -> pa.RecordBatch:
        row, k = (np.concatenate(x) for x in zip(*wait, strict=True))
        rows, at = np.unique(row, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(at, weights=costs(tables, k, order)))], names=["row", "p"])

    both = entries.select(F.lit(-1).cast("long").alias("row"), "k", "n").unionByName(asked.select("row", "k", F.lit(0).cast("long").alias("n")))
    return _dealt(both, max(size, most // 4)).sortWithinPartitions("row").mapInArrow(run, "row long, p double").groupBy("row").agg(F.sum("p").alias("p"))


@lru_cache(maxsize=1)
def _load(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """The held keys, sorted, and their log10 probabilities; once per worker."""
    k, p = read_parts(uri, {"k": "int64", "p": "float64"})
    k = k.view(_U)
    at = np.argsort(k)
    k = k[at]
    p = p[at]
    del at
    release()
    return k, p


holds("ppm-trie", _low_tables.cache_clear)
holds("ppm", _common.cache_clear, _load.cache_clear)


def score(docs: DataFrame, training: DataFrame, order: int = 6, frequent: int = 1 << 17, held: int = 4_000_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every
    row of ``docs`` (doc_id, text), learning from ``training`` (text).

    ``score`` is the model's log10 probability of the text; ``base_score`` the
    sum over tokens of log10((c+1)/(N+V+1)), with c the token's count, N all
    and V distinct training tokens, ends included.  A null text is empty: its
    end alone.  Rows that share an id are scored apart.  Without any training
    row N and V are 0 and all symbols alike.  Other columns are ignored; an
    empty table stays empty.
    """
    spark = docs.sparkSession
    words = durable(word_counts(training), "ppm-words")
    ends = training.count()
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0) + ends, int(total["v"]) + (ends > 0)
    entries = key_counts(training, order, n)
    low = _low(entries, order)
    distinct, least = _least(entries, "n", held)  # the commonest keys, as far as ``held`` goes
    uri = fresh_path(spark, "ppm-held")
    _priced(entries, distinct, low, order, least).write.parquet(uri)
    common = fresh_path(spark, "ppm-common")
    words.where(F.col("c") >= _least(words, "c", frequent)[1]).write.parquet(common)
    end_base, one = math.log10((ends + 1) / (n + v + 1)), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("ppm")
        keys, probs = _load(uri)
        places, bases = _common(common)
        bases = np.log10((bases + 1) / (n + v + 1))
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))
        for texts, part in grouped(batches, 256):
            texts = [tokens(t) for t in texts]
            size = np.fromiter(map(len, texts), "int64", len(texts))
            flat, own = list(chain.from_iterable(texts)), np.repeat(np.arange(len(texts)), size)
            at = np.fromiter(map(places.get, flat, repeat(-1)), "int64", len(flat))
            here = at >= 0
            base = np.bincount(own[here], weights=bases[at[here]], minlength=len(texts)) + end_base
            known = np.bincount(own[here], minlength=len(texts)) + one
            far_words = list(compress(flat, ~here))
            stops = np.r_[0, np.cumsum(size + one - known)].tolist()
            others = [Counter(far_words[lo:hi]) for lo, hi in zip(stops[:-1], stops[1:], strict=True)]
            k, starts = stream_keys(texts, order)
            u, inv = np.unique(k, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, u), max(0, len(keys) - 1))
            here = keys[at] == u if len(keys) else np.zeros(len(u), bool)
            prob = np.add.reduceat(np.where(here, probs[at] if len(keys) else 0.0, 0.0)[inv], starts)
            far = ~here[inv]
            asks = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.add.reduceat(far, starts, dtype="int64"))], pa.int32()), pa.array(k[far].view("int64")))
            rare = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0] + [len(x) for x in others]), pa.int32()),
                pa.StructArray.from_arrays([pa.array([w for x in others for w in x], pa.binary()), pa.array([n for x in others for n in x.values()], pa.int64())], fields=list(rare_type.value_type)),
            )
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(size + 1, pa.int64()), pa.array(base), pa.array(known, pa.int64()), pa.array(prob), rare, asks], names=["row", "doc_id", "n_tokens", "base", "known", "score", "rare", "asks"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    done = durable(numbered.mapInArrow(run, "row long, doc_id long, n_tokens long, base double, known long, score double, rare array<struct<word: binary, tf: long>>, asks array<long>"), "ppm-scores")
    asked = done.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    found = asked.join(words, "word", "left").groupBy("row").agg(F.sum(F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("seen"))
    most = done.agg(F.sum(F.size("asks"))).first()[0] or 0
    far = _asked(entries, distinct, low, order, done.select("row", F.explode("asks").alias("k")), most).withColumnRenamed("p", "far")
    out = done.drop("rare", "asks").join(found, "row", "left").join(far, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"))
