"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over all their words and word beginnings; no term is
left out of a vector.  A term's idf has two factors: the usual one, over all
documents, and how far its document frequencies among toxic and among clean
examples lie apart (the difference of the two logarithms, as in delta TF-IDF),
so that terms that say nothing about the label weigh next to nothing.

The examples (a bounded sample of the labelled rows) lie in an inverted index
cut into blocks; each term knows its largest weight per block.  A query visits
blocks by descending bound and stops when no block can reach its k-th cosine,
so the neighbours are exact.  Votes are weighted by cosine.  Monotone
regression turns them into probabilities at the labels' own ratio; it is fitted
on votes of examples that had no part in their weights or index (folds).

Terms are 64-bit hashes.  The sample's vocabulary, its document frequencies and
the index are files in the shared folder, which workers read once; nothing but
counts of labels comes to the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import _fs, durable, fresh_path, grouped, holds, read_table, release, small_batches, turn_to

_TOKEN = re.compile(r"[^\W_]+")
#: Lengths of word beginnings that are terms of their own.
STEMS = (5,)
_WIDTH = 1 + len(STEMS)
#: Slices that document frequencies are added up in, and tasks whose arrays of a slice one task adds up.
SLICES, FAN = 16, 64
#: Texts scored at once, and postings added up at once.
GROUP, POSTINGS = 128, 1 << 20
#: A term that no example has counts as so many examples, dealt by the labels' ratio.
PRIOR = 1.0


def terms_of(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


_LONG = 32
_ODD = np.random.default_rng(19).integers(1, 1 << 63, _LONG, "uint64") | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def term_hashes(words: list[str]) -> np.ndarray:
    """A row per word: the hashes of its terms, 0 for a beginning that it is
    too short for."""
    size = np.fromiter(map(len, words), "uint64", len(words))
    letters = np.array([w[:_LONG] for w in words], f"<U{_LONG}").view("uint32").reshape(len(words), _LONG).astype("uint64")
    sums = np.cumsum(letters * _ODD, axis=1)
    own = [_mix(sums[:, -1] + size * np.uint64(0x9E3779B97F4A7C15))]
    for n in STEMS:
        own.append(np.where(size >= n, _mix(sums[:, n - 1] ^ np.uint64(n << 56)) | np.uint64(1), np.uint64(0)))
    out = np.stack(own, axis=1)
    out[:, 0] |= np.uint64(1)
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i, 0] = xxhash.xxh3_64_intdigest(words[i]) | 1
    return out


class Terms:
    """Counts of texts' terms by place in a vocabulary (sorted hashes).  Words
    that were met are remembered, about ``most`` of them."""

    def __init__(self, vocabulary: np.ndarray | None = None, most: int = 80_000):
        self.vocabulary, self.most = vocabulary, most
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, _WIDTH), "uint64" if self.vocabulary is None else "int64")

    def _learn(self, words: list[str]) -> None:
        n, own = len(self.place), term_hashes(words)
        if self.vocabulary is not None:  # places count from 1; 0 is no term
            v = self.vocabulary
            at = np.minimum(np.searchsorted(v, own), max(0, len(v) - 1))
            own = np.where(v[at] == own, at + 1, 0) if len(v) else np.zeros(own.shape, "int64")
        while len(self.rows) < n + len(words):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(words)] = own
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def _placed(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and the words' places in a row."""
        words = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
        size = np.fromiter(map(len, words), "int64", len(words))
        flat = list(chain.from_iterable(words))
        if len(self.place) > self.most:
            self._forget()
        at = np.fromiter(map(self.place.get, flat, repeat(-1)), "int64", len(flat))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(flat[i] for i in new)))
            at[new] = [self.place[flat[i]] for i in new]
        return size, at

    def hashes(self, texts: list[str | None]) -> np.ndarray:
        """The distinct hashes of all terms of the texts."""
        at = np.unique(self._placed(texts)[1])
        found = np.unique(self.rows[at])
        return found[found > 0]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's terms begin (and the last's end); the terms,
        ascending; how often each occurs."""
        size, at = self._placed(texts)
        words = max(1, len(self.place))
        u, n = np.unique(np.repeat(np.arange(len(texts)), size) * words + at, return_counts=True)
        ids = self.rows[u % words].ravel()
        of, tf = np.repeat(u // words, _WIDTH), np.repeat(n, _WIDTH)
        keep, width = ids > 0, len(self.vocabulary) + 1
        bits = 62 - (len(texts) * width).bit_length()  # text, term and count in one number, which sorts fast
        if len(tf) and int(tf.max()).bit_length() > bits:
            raise ValueError("a word occurs too often for one number")
        x = np.sort(((of[keep] * width + ids[keep]) << bits) + tf[keep])
        key, tf = x >> bits, x & ((1 << bits) - 1)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        start = np.searchsorted(key[first], np.arange(len(texts) + 1) * width)
        return start, key[first] % width - 1, np.add.reduceat(tf, first).astype("float64") if len(first) else np.empty(0)


def _reach(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


def _unit(weight: np.ndarray, start: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    """TF-IDF weights of texts' terms, each text's of length 1 in all (or 0)."""
    w = (1 + np.log(tfs)) * weight[ids]
    norm = np.sqrt(np.bincount(np.repeat(np.arange(len(start) - 1), np.diff(start)), weights=w * w, minlength=len(start) - 1))
    return w / np.repeat(np.where(norm > 0, norm, 1.0), np.diff(start))


@dataclass
class Index:
    """Unit vectors of examples in blocks.  Lists of common terms are dense, a
    row per term; those of other terms are pairs of example and weight.  Each
    common term has its largest weight per block."""

    weight: np.ndarray
    label: np.ndarray
    doc_id: np.ndarray
    post_e: np.ndarray
    post_w: np.ndarray
    start: np.ndarray
    block: int = 32
    #: A term is common that so large a part of the examples has.
    common: float = 1 / 16

    @staticmethod
    def build(weight: np.ndarray, label: np.ndarray, doc_id: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], **how) -> Index:
        """rows: the examples' terms and counts, as Terms.counts gives them."""
        start, ids, tfs = rows
        w = _unit(weight, start, ids, tfs)
        e = np.repeat(np.arange(len(label), dtype="int32"), np.diff(start))
        order = np.argsort(ids, kind="stable")
        return Index(weight, label, doc_id, e[order], w[order], np.searchsorted(ids[order], np.arange(len(weight) + 1)), **how)

    def __post_init__(self) -> None:
        n, size = len(self.label), np.diff(self.start)
        self.blocks = max(1, -(-n // self.block))
        dense = np.flatnonzero(size > max(1, n * self.common))
        self.row = np.full(len(size), -1)
        self.row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), self.blocks * self.block))
        at = _reach(self.start[dense], self.start[dense + 1])
        self.dense[np.repeat(np.arange(len(dense)), size[dense]), self.post_e[at]] = self.post_w[at]
        self.top = self.dense.reshape(len(dense), self.blocks, self.block).max(axis=2)
        self.dense = np.ascontiguousarray(self.dense.reshape(len(dense), self.blocks, self.block).transpose(1, 0, 2))

    def nearest(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text (rows as Terms.counts gives them) the k examples of
        largest cosine, ties to the earlier one, and the cosines; a cosine of 0
        stands for no neighbour.

        The lists of rare terms are added up.  That, and for each block the
        largest weights of the common ones, bound a block's cosines.  The first
        blocks by bound are completed, then all that can reach the k-th best."""
        start, ids, tfs = rows
        q, w = len(start) - 1, _unit(self.weight, *rows)
        of = np.repeat(np.arange(q), np.diff(start))
        row = self.row[ids]
        rare = np.flatnonzero((row < 0) & (w > 0))
        wide = self.blocks * self.block
        s = np.zeros((q, wide))
        lo, hi = self.start[ids[rare]], self.start[ids[rare] + 1]
        for i in np.array_split(np.arange(len(rare)), 1 + int((hi - lo).sum()) // POSTINGS):
            at, n = _reach(lo[i], hi[i]), (hi - lo)[i]
            first, last = (int(of[rare[i[0]]]), int(of[rare[i[-1]]]) + 1) if len(i) else (0, 0)
            sums = np.bincount(np.repeat((of[rare[i]] - first) * wide, n) + self.post_e[at], weights=self.post_w[at] * np.repeat(w[rare[i]], n), minlength=(last - first) * wide)
            s[first:last] += sums.reshape(last - first, wide)
        x = np.zeros((q, len(self.top)))
        x[of[row >= 0], row[row >= 0]] = w[row >= 0]
        bound = x @ self.top + s.reshape(q, self.blocks, self.block).max(axis=2)
        k = min(k, len(self.label))
        if not k:
            return np.zeros((q, 0), int), np.zeros((q, 0))
        first = min(self.blocks, 1 + -(-k // self.block))
        now = np.zeros((q, self.blocks), bool)
        now[np.arange(q)[:, None], np.argpartition(-bound, first - 1, axis=1)[:, :first]] = True
        self._complete(s, x, now)
        kth = np.partition(s, -k, axis=1)[:, -k]  # what is not complete is a lower bound
        more = (bound >= kth[:, None] - 1e-11) & ~now
        self._complete(s, x, more)
        s = np.where(np.repeat(now | more, self.block, axis=1), s, 0.0)[:, : len(self.label)]
        rank = s.round(11) - np.arange(len(self.label)) * (1e-11 / (1 + len(self.label)))
        best = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(rank, best, axis=1), axis=1), axis=1)
        return best, np.take_along_axis(s, best, axis=1)

    def _complete(self, s: np.ndarray, x: np.ndarray, which: np.ndarray) -> None:
        for b in np.flatnonzero(which.any(axis=0)).tolist():
            q = np.flatnonzero(which[:, b])
            s[q, b * self.block : (b + 1) * self.block] += x[q] @ self.dense[b]


def weights(rows: tuple[np.ndarray, np.ndarray, np.ndarray], label: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Of each term: idf times the distance of its log document frequencies
    among toxic and clean examples; 0 for a term that no example has."""
    start, ids, _ = rows
    y = np.repeat(label, np.diff(start))
    seen = [np.bincount(ids[y == v], minlength=len(idf)) for v in (0, 1)]
    n = [float((label == v).sum()) for v in (0, 1)]
    if not n[0] or not n[1]:
        return np.zeros(len(idf))
    clean, toxic = (np.log((seen[v] + PRIOR * n[v] / len(label)) / (n[v] + PRIOR)) for v in (0, 1))
    return np.where(seen[0] + seen[1] > 0, idf * np.abs(toxic - clean), 0.0)


def votes(label: np.ndarray, found: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """Toxic share of each text's neighbours, weighted by cosine; none: 0."""
    total = cos.sum(axis=1)
    return (cos * label[found]).sum(axis=1) / np.where(total > 0, total, 1.0)


def monotone(v: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted monotone regression of y on v by pooling neighbours."""
    order = np.argsort(v, kind="stable")
    pools: list[list[float]] = []  # sum of wy, sum of w, sum of wv
    for x, t, u in zip(v[order], y[order], w[order], strict=True):
        pools.append([u * t, u, u * x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def chosen(rows: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows at these places, in this order."""
    start, ids, tfs = rows
    take = _reach(start[at], start[at + 1])
    return np.r_[0, np.cumsum(start[at + 1] - start[at])], ids[take], tfs[take]


def arranged(rows: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray, size: int) -> np.ndarray:
    """An order that puts alike examples into the same blocks: by the heaviest
    terms that at least ``size`` examples share."""
    start, ids, _ = rows
    often, w = np.bincount(ids, minlength=len(weight)), _unit(weight, *rows)
    w = np.where(often[ids] >= size, w, 0.0)
    keys = [(*ids[lo:hi][np.argsort(-w[lo:hi], kind="stable")[:3]].tolist(), e) for e, (lo, hi) in enumerate(zip(start[:-1].tolist(), start[1:].tolist(), strict=True))]
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), int)


@dataclass
class Scorer:
    index: Index
    k: int
    votes: np.ndarray
    share: np.ndarray

    def score(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of texts, their neighbours and the cosines."""
        found, cos = self.index.nearest(rows, self.k)
        v = votes(self.index.label, found, cos)
        return np.clip(0.99 * np.interp(v, self.votes, self.share) + 0.01 * v, 0, 1), found, cos


def fit(rows: tuple[np.ndarray, np.ndarray, np.ndarray], label: np.ndarray, doc_id: np.ndarray, idf: np.ndarray, k: int, ratio: float, folds: int = 4) -> Scorer:
    """The index of all examples, and votes to probabilities by examples that
    the index and the weights of their votes did not know.  ``ratio`` is the
    toxic share of the labelled rows that the examples stand for."""
    found = np.zeros(len(label))
    fold = np.zeros(len(label), int)
    for y in (0, 1):
        at = np.flatnonzero(label == y)
        fold[at] = np.arange(len(at)) % folds
    for f in range(folds):
        mine, others = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        own = chosen(rows, mine)
        index = Index.build(weights(own, label[mine], idf), label[mine], doc_id[mine], own)
        for lo in range(0, len(others), GROUP):
            part = others[lo : lo + GROUP]
            found[part] = votes(index.label, *index.nearest(chosen(rows, part), k))
    mean = max(1e-9, min(1 - 1e-9, label.mean()))
    v, share = monotone(found, label, np.where(label > 0, ratio / mean, (1 - ratio) / (1 - mean)))
    w = weights(rows, label, idf)
    order = arranged(rows, w, 32)
    return Scorer(Index.build(w, label[order], doc_id[order], chosen(rows, order)), k, v, share)


def examples(labelled: DataFrame, most_toxic: int, most_clean: int, seed: int) -> tuple[DataFrame, float, bool]:
    """A sample of (doc_id, toxic) rows by seeded hash, at most so many of each
    label; the toxic share of all labelled rows; whether there are both labels."""
    n = {r["k"]: r["n"] for r in labelled.groupBy((F.col("toxic") > 0).alias("k")).agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    most = F.when(F.col("toxic") > 0, F.lit(float(most_toxic)) / max(1, n.get(True, 0))).otherwise(F.lit(float(most_clean)) / max(1, n.get(False, 0)))
    thin = labelled.withColumn("_place", place).where(F.col("_place") <= 1.5 * most)
    rank = F.row_number().over(W.partitionBy(F.col("toxic") > 0).orderBy("_place", "doc_id"))
    limit = F.when(F.col("toxic") > 0, most_toxic).otherwise(most_clean)
    return thin.withColumn("_rank", rank).where(F.col("_rank") <= limit).select("doc_id", "toxic"), n.get(True, 0) / max(1, sum(n.values())), len(n) == 2


@lru_cache(maxsize=1)
def _vocabulary(uri: str) -> np.ndarray:
    return np.sort(read_table(uri).column("h").to_numpy().view("uint64"))


def _write_vocabulary(sampled: DataFrame) -> str:
    """The distinct hashes of the sample's terms, as a table; its place."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("toxicity")
        terms = Terms()
        for texts, _ in grouped(batches, GROUP):
            yield pa.RecordBatch.from_arrays([pa.array(terms.hashes(texts).view("int64"))], names=["h"])
        del terms
        release()

    uri = fresh_path(sampled.sparkSession, "toxicity-vocabulary")
    sampled.select("text").mapInArrow(explode, "h long").distinct().write.parquet(uri)
    return uri


def _write_frequencies(docs: DataFrame, vocabulary: str) -> str:
    """(slice, n, counts): numbers of documents, and of those that have each
    term of a slice of the vocabulary, over all whole texts.  A task sends one
    array per slice; a task adds up the arrays of a slice from at most ``FAN``
    tasks, twice, and the last step those of the rest: the tasks that add up
    grow with those that read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("toxicity")
        v = _vocabulary(vocabulary)
        terms, seen, n = Terms(v), np.zeros(len(v), "int64"), 0
        for texts, _ in grouped(batches, GROUP):
            n += len(texts)
            np.add.at(seen, terms.counts(texts)[1], 1)
        del terms  # the worker may wait beside others until it gets another task
        release()
        cut = np.array_split(seen, SLICES)
        group = TaskContext.get().partitionId() // FAN
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([group] * SLICES, pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["slice", "group", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            for slice_, group, n, raw in zip(*(b.column(c).to_pylist() for c in ("slice", "group", "n", "counts")), strict=True):
                held = total.setdefault((slice_, group), [0, 0])
                held[0] += n
                held[1] = held[1] + np.frombuffer(raw, "int64")
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int32()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([x[0] for _, x in rows], pa.int64()), pa.array([x[1].tobytes() for _, x in rows], pa.binary())], names=["slice", "group", "n", "counts"])

    schema = "slice int, group int, n long, counts binary"
    sums = docs.select("text").mapInArrow(count, schema).repartition("slice", "group").mapInArrow(add, schema)
    sums = sums.withColumn("group", F.expr(f"group div {FAN}").cast("int")).repartition("slice", "group").mapInArrow(add, schema)
    sums = sums.withColumn("group", F.lit(0)).repartition(SLICES, "slice").mapInArrow(add, schema)
    uri = fresh_path(docs.sparkSession, "toxicity-frequencies")
    sums.drop("group").write.parquet(uri)
    return uri


def _idf(vocabulary: str, frequencies: str) -> np.ndarray:
    t = read_table(frequencies).sort_by("slice")
    n = max([1, *t.column("n").to_pylist()])
    df = np.concatenate([np.empty(0), *[np.frombuffer(x, "int64") for x in t.column("counts").to_pylist()]])
    return np.log((1 + n) / (1 + df)) + 1


_ARRAYS = ("weight", "label", "doc_id", "post_e", "post_w", "start")


def _write_scorer(sampled: DataFrame, vocabulary: str, frequencies: str, k: int, ratio: float) -> str:
    """Fit in one task (the sample is bounded) and write the model's arrays; its place."""
    base = fresh_path(sampled.sparkSession, "toxicity-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("toxicity")
        terms, got = Terms(_vocabulary(vocabulary)), []
        for texts, b in grouped(batches, GROUP):
            start, ids, tfs = terms.counts(texts)
            for n, (i, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic")), strict=True)):
                got.append((i, float(y > 0), ids[start[n] : start[n + 1]], tfs[start[n] : start[n + 1]]))
        if not got:
            return
        got.sort(key=lambda r: r[0])
        start, ids, tfs = np.r_[0, np.cumsum([len(r[2]) for r in got])], np.concatenate([r[2] for r in got]), np.concatenate([r[3] for r in got])
        label, doc_id = np.array([r[1] for r in got]), np.array([r[0] for r in got], "int64")
        got.clear()
        made = fit((start, ids, tfs), label, doc_id, _idf(vocabulary, frequencies), k, ratio)
        fs, path = _fs(f"{base}/{uuid.uuid4().hex}.arrow")
        fs.create_dir(path.rsplit("/", 1)[0])
        arrays = [*[(n, getattr(made.index, n)) for n in _ARRAYS], ("votes", made.votes), ("share", made.share)]
        with fs.open_output_stream(path) as out:
            for _, x in arrays:
                batch = pa.record_batch([pa.array(x)], names=["x"])
                with ipc.new_stream(out, batch.schema) as file:
                    file.write_batch(batch)
        del made, arrays, x, batch, start, ids, tfs, terms
        release()
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    done = durable(sampled.select("doc_id", "toxic", "text").coalesce(1).mapInArrow(run, "path string"), "toxicity-model")
    return f"{base}/{done.first()['path'].rsplit('/', 1)[1]}"


@lru_cache(maxsize=1)
def _load(uri: str, k: int) -> Scorer:
    fs, path = _fs(uri)
    with fs.open_input_stream(path) as f:
        arrays = [ipc.open_stream(f).read_all().column("x").to_numpy() for _ in (*_ARRAYS, "votes", "share")]
    return Scorer(Index(*arrays[: len(_ARRAYS)]), k, *arrays[len(_ARRAYS) :])


holds("toxicity", _vocabulary.cache_clear, _load.cache_clear)


def score_toxicity(docs: DataFrame, labels: DataFrame, k: int = 30, most_toxic: int = 800, most_clean: int = 2000, seed: int = 11, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with ``score`` and
    ``evidence``: its three nearest examples (doc_id, cosine, toxic).

    ``labels`` (doc_id, toxic) are the rows to learn from; their texts are
    looked up in ``docs``.  Rows with null id or label are left out; repeated
    ids count once (toxic if any is), with the least of their texts.  The sample
    (``most_toxic`` and ``most_clean`` rows, by seeded hash of the id) bounds
    what a worker holds; document frequencies cover all documents.  Texts that
    are null, empty or share no term with an example have a vote of 0 and no
    evidence.  Without both labels in the sample every score is 0.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked, ratio, both = examples(known, most_toxic, most_clean, seed)
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = text.join(F.broadcast(picked), "doc_id")  # at most most_toxic + most_clean ids
    sampled = durable(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-examples")
    both = both and sampled.agg(F.count_distinct(F.col("toxic") > 0)).first()[0] == 2
    uri = None
    if both:
        vocabulary = _write_vocabulary(sampled)
        uri = _write_scorer(sampled, vocabulary, _write_frequencies(docs, vocabulary), k, ratio)
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    columns = list(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("toxicity")
        scorer, terms = (_load(uri, k), Terms(_vocabulary(vocabulary))) if both else (None, None)
        for texts, b in grouped(batches, GROUP):
            s, near = np.zeros(len(texts)), pa.array([[]] * len(texts), kind)
            if scorer is not None:
                distinct, own = np.unique(np.array([t or "" for t in texts], object), return_inverse=True)
                s, found, cos = scorer.score(terms.counts(distinct.tolist()))
                index, found, cos = scorer.index, found[:, :3], cos[:, :3]
                shown = [[{"doc_id": int(index.doc_id[e]), "cosine": float(c), "toxic": int(index.label[e])} for e, c in zip(f, x, strict=True) if c > 0] for f, x in zip(found.tolist(), cos.tolist(), strict=True)]
                s, near = s[own], pa.array([shown[i] for i in own.tolist()], kind)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(s, pa.float64()), near], names=[*columns, "score", "evidence"])
        _load.cache_clear()
        _vocabulary.cache_clear()
        scorer = terms = index = None
        release()

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(score, schema)
