"""Phrase collocations from vertical positional lists.

Texts are cut into blocks of about two million words of one language.  Within a
block every frequent word has the ascending list of its positions; a frequent
phrase is extended by merging the list of its occurrences with the lists of the
phrases that begin one word later, so a list's length is the exact frequency in
the block.  Blocks send the lengths of their lists, dealt by a hash of the
phrase; a part adds them up, keeps phrases that are frequent in the whole
corpus and tells each block which of its lists those are.  Only they are
extended to the next length.  Every round reads the blocks' words from a
durable table; nothing passes one task or the driver whole.

What a task holds is a block or a part: both are cut by amount of data, so
tasks grow in number, not in size.  A word or phrase that is everywhere has one
entry per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, release, shuffle_partitions

#: Words of a block, of all blocks that a task fills at once, and entries of a part.
BLOCK_WORDS, OPEN_WORDS, PART_ENTRIES = 1 << 21, 1 << 22, 1 << 21
#: Bytes of a text that are taken at once.
SLICE = 1 << 20
#: Parts in which each language's best phrases are found first.
SALTS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(bytes(range(65, 91)) + _BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(_BREAKS) + b" ")


def _packed(x: np.ndarray) -> bytes:
    """Integers by byte plane, compressed: high bytes are mostly alike."""
    planes = np.ascontiguousarray(x.view("uint8").reshape(len(x), x.itemsize).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def _unpacked(raw: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), "uint8").reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class _Ids(dict):
    """Numbers of words in order of appearance; 0 is a break, 1 no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A cleaned text in slices that end at a break, else at the end of a word."""
    lo = 0
    while len(data) - lo > size:
        hi = data.rfind(b"\n", lo, lo + size) + 1 or data.rfind(b" ", lo, lo + size) + 1
        if hi <= lo:
            ends = [x for x in (data.find(b"\n", lo + size), data.find(b" ", lo + size)) if x >= 0]
            hi = min(ends) + 1 if ends else len(data)
        yield data[lo:hi]
        lo = hi
    if lo < len(data):
        yield data[lo:]


class _Block:
    """Words of one language while they come in.  ``context``: so many words at
    its start belong to the block before, and only lead phrases in."""

    def __init__(self, longest: int, lead: list[bytes] | None = None):
        self.ids, self.longest = _Ids(), longest
        self.parts: list[np.ndarray] = []
        self.context = len(lead or ())
        self.words = 0
        if lead:
            self.parts.append(np.array([self.ids[w] for w in lead], "int32"))

    def add(self, data: bytes) -> None:
        found = data.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.ids.__getitem__, found), "int32", len(found))
        ids = ids[ids != 1]
        self.parts.append(ids)
        self.words += len(ids)

    def end(self) -> None:
        self.parts.append(np.zeros(1, "int32"))

    def lead(self) -> list[bytes]:
        """The last words, as far as no break parts them from what follows."""
        tail = np.concatenate(self.parts)[-(self.longest - 1) :] if self.longest > 1 else np.empty(0, "int32")
        cut = np.flatnonzero(tail == 0)
        names = list(self.ids)
        return [names[i] for i in tail[cut[-1] + 1 if len(cut) else 0 :].tolist()]

    def row(self, block: int, lang: str) -> list:
        ids = np.concatenate([np.zeros(0, "int32"), *self.parts])
        ids = np.where(ids > 1, ids - 1, 0).astype("int32")  # words from 1
        names = list(self.ids)[2:]
        counts = np.bincount(ids[self.context :], minlength=len(names) + 1)[1:]
        return [block, lang, len(ids), self.context, _packed(ids), int(counts.sum()), names, counts]


_BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int32()), ("context", pa.int32()), ("ids", pa.binary()), ("words", pa.int64()), ("names", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_BLOCKS_SQL = "block long, lang string, n int, context int, ids binary, words long, names array<string>, counts array<long>"


def _to_blocks(batches: Iterator[pa.RecordBatch], longest: int, block_words: int) -> Iterator[pa.RecordBatch]:
    open_: dict[str, _Block] = {}
    seq, first = 0, TaskContext.get().partitionId() << 32

    def close(lang: str) -> pa.RecordBatch:
        nonlocal seq
        row = open_.pop(lang).row(first + seq, lang)
        seq += 1
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row[:6], _BLOCKS.types, strict=False)] + [pa.array([row[6]], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([row[7]], pa.list_(pa.int64()))], schema=_BLOCKS)

    for b in batches:
        for lang, raw in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            held = open_.setdefault(lang, _Block(longest))
            for data in slices((raw or b"").translate(_CLEAN)):
                if held.words >= block_words:  # within a long text
                    lead = held.lead()
                    yield close(lang)
                    held = open_[lang] = _Block(longest, lead)
                held.add(data)
            held.end()
            if held.words >= block_words:
                yield close(lang)
        while sum(x.words for x in open_.values()) >= 2 * block_words:
            yield close(max(open_, key=lambda x: open_[x].words))
    for lang in list(open_):
        yield close(lang)
    release()


def _word_parts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A block's words and counts by part."""
    for b in batches:
        for block, lang, names, counts in zip(*(b.column(c) for c in ("block", "lang", "names", "counts")), strict=True):
            names, counts = names.values, counts.values
            dealt = np.fromiter((zlib.crc32(w) % parts for w in names.cast(pa.binary()).to_pylist()), "int64", len(names))
            order = np.argsort(dealt, kind="stable")
            cuts = np.searchsorted(dealt[order], np.arange(parts + 1))
            rows = [(p, order[cuts[p] : cuts[p + 1]]) for p in range(parts) if cuts[p] < cuts[p + 1]]
            for lo in range(0, len(rows), 64):
                some = rows[lo : lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.as_py()] * len(some), pa.int64()), pa.array([lang.as_py()] * len(some), pa.string()), pa.array([p for p, _ in some], pa.int32()),
                        pa.array([i.astype("int32") for _, i in some], pa.list_(pa.int32())), pa.array([names.take(pa.array(i)).to_pylist() for _, i in some], pa.list_(pa.string())), pa.array([counts.take(pa.array(i)).to_numpy(zero_copy_only=False) for _, i in some], pa.list_(pa.int64())),
                    ],
                    names=["block", "lang", "part", "local", "names", "counts"],
                )


#: What a part tells: of each block its lists that go on (numbers in the block
#: and in the corpus), and once what is frequent.
_TOLD = "block long, m int, local binary, gid binary, gids array<long>, langs array<string>, names array<string>, lefts array<long>, rights array<long>, totals array<long>"
_TOLD_TYPES = [("block", pa.int64()), ("m", pa.int32()), ("local", pa.binary()), ("gid", pa.binary()), ("gids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("names", pa.list_(pa.string())), ("lefts", pa.list_(pa.int64())), ("rights", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))]
_TOLD_SCHEMA = pa.schema(_TOLD_TYPES)


def _told(part: int, parts: int, block: np.ndarray, local: np.ndarray, group: np.ndarray, totals: np.ndarray, least: int, facts: dict) -> pa.Table:
    """Rows for the blocks whose entries belong to groups of enough in total,
    and one row of the groups; ``facts``: columns of the groups."""
    kept = totals >= least
    gid = np.where(kept, part + parts * (np.cumsum(kept) - 1), -1).astype("int64")
    mine = gid[group]
    on = mine >= 0
    block, local, mine = block[on], local[on], mine[on]
    order = np.argsort(block, kind="stable")
    block, local, mine = block[order], local[order], mine[order]
    blocks, starts = np.unique(block, return_index=True)
    ends = np.append(starts, len(block))[1:]
    rows = [dict(block=int(x), m=int(hi - lo), local=_packed(local[lo:hi].astype("int32")), gid=_packed(mine[lo:hi])) for x, lo, hi in zip(blocks, starts, ends, strict=True)]
    rows.append(dict(gids=gid[kept], totals=totals[kept], **{k: f(np.flatnonzero(kept)) for k, f in facts.items()}))
    return pa.Table.from_pydict({n: pa.array([r.get(n) for r in rows], kind) for n, kind in _TOLD_TYPES}, schema=_TOLD_SCHEMA)


def _add_words(t: pa.Table, parts: int, least: int) -> pa.Table:
    sizes = np.array([len(x) for x in t.column("local").to_pylist()], "int64")
    flat = lambda c: t.column(c).combine_chunks().flatten()
    names = flat("names").dictionary_encode()
    langs = t.column("lang").combine_chunks().dictionary_encode()
    key = names.indices.to_numpy().astype("int64") * len(langs.dictionary) + np.repeat(langs.indices.to_numpy().astype("int64"), sizes)
    keys, group = np.unique(key, return_inverse=True)
    totals = np.zeros(len(keys), "int64")
    np.add.at(totals, group, flat("counts").to_numpy())
    block = np.repeat(t.column("block").to_numpy(), sizes)
    facts = {"names": lambda i: names.dictionary.take(pa.array(keys[i] // len(langs.dictionary))).to_pylist(), "langs": lambda i: langs.dictionary.take(pa.array(keys[i] % len(langs.dictionary))).to_pylist()}
    return _told(t.column("part")[0].as_py(), parts, block, flat("local").to_numpy(), group, totals, least, facts)


class Lists:
    """The lists of a block's frequent phrases of one length, merged: ascending
    positions of their first words, which phrase each is of, and the phrases'
    numbers in the corpus."""

    def __init__(self, at: np.ndarray, code: np.ndarray, gids: np.ndarray):
        self.at, self.code, self.gids = at, code, gids

    def extended(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge the lists with those that begin one word later: positions of
        the longer phrases, which pair each is of, and the pairs (code of the
        beginning times phrases plus code of the end), ascending."""
        nxt = np.searchsorted(self.at, self.at + 1)
        there = np.flatnonzero((nxt < len(self.at)) & (self.at[np.minimum(nxt, len(self.at) - 1)] == self.at + 1)) if len(self.at) else np.empty(0, "int64")
        pairs, which = np.unique(self.code[there].astype("int64") * max(1, len(self.gids)) + self.code[nxt[there]], return_inverse=True)
        return self.at[there], which, pairs

    @staticmethod
    def of(at: np.ndarray, which: np.ndarray, n: int, local: np.ndarray, gids: np.ndarray) -> Lists:
        """Only the lists ``local`` (of n) go on."""
        code = np.full(n, -1, "int32")
        code[local] = np.arange(len(local), dtype="int32")
        code = code[which]
        on = code >= 0
        return Lists(at[on], code[on], gids)


def _lists(state: dict, told: pa.Table, length: int) -> Lists:
    """A block's lists of frequent phrases of ``length`` words."""
    ids = _unpacked(state["ids"], state["n"], "int32")
    found = None
    for k in range(1, length + 1):
        rows = told.filter(pc.equal(told.column("length"), k)).to_pylist()
        local = np.concatenate([np.empty(0, "int32"), *(_unpacked(r["local"], r["m"], "int32") for r in rows)])
        gids = np.concatenate([np.empty(0, "int64"), *(_unpacked(r["gid"], r["m"], "int64") for r in rows)])
        order = np.argsort(local)  # parts come in any order; numbers of longer lists follow from this one
        local, gids = local[order], gids[order]
        if k == 1:
            at = np.flatnonzero(ids)
            found = Lists.of(at, ids[at] - 1, int(ids.max(initial=0)), local, gids)
        else:
            at, which, pairs = found.extended()
            found = Lists.of(at, which, len(pairs), local, gids)
    return found


_ENTRIES = "block long, part int, m int, local binary, lefts binary, rights binary, counts binary"
_ENTRIES_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("m", pa.int32()), *((c, pa.binary()) for c in ("local", "lefts", "rights", "counts"))])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _extend(state: pa.Table, told: pa.Table, length: int, parts: int) -> pa.Table:
    """The entries of a block's phrases of length + 1 words, by part."""
    if not len(state) or not len(told):
        return _ENTRIES_SCHEMA.empty_table()
    state = state.to_pylist()[0]
    lists = _lists(state, told, length)
    at, which, pairs = lists.extended()
    counts = np.bincount(which[at + length >= state["context"]], minlength=len(pairs)).astype("int64")
    m = max(1, len(lists.gids))
    lefts, rights = (lists.gids[x] for x in (pairs // m, pairs % m))
    with np.errstate(over="ignore"):
        mixed = (lefts.view("uint64") * _ODD) ^ (rights.view("uint64") + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
        dealt = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype("int64")
    order = np.argsort(dealt, kind="stable")
    cuts = np.searchsorted(dealt[order], np.arange(parts + 1))
    own = [(p, order[cuts[p] : cuts[p + 1]]) for p in range(parts) if cuts[p] < cuts[p + 1]]
    rows = [dict(block=state["block"], part=p, m=len(i), local=_packed(i.astype("int32")), lefts=_packed(lefts[i]), rights=_packed(rights[i]), counts=_packed(counts[i])) for p, i in own]
    return pa.Table.from_pylist(rows, schema=_ENTRIES_SCHEMA)


def _add_phrases(t: pa.Table, parts: int, least: int) -> pa.Table:
    m = t.column("m").to_pylist()
    local, left, right, count = (np.concatenate([_unpacked(raw, n, kind) for raw, n in zip(t.column(c).to_pylist(), m, strict=True)]) for c, kind in (("local", "int32"), ("lefts", "int64"), ("rights", "int64"), ("counts", "int64")))
    block = np.repeat(t.column("block").to_numpy(), m)
    order = np.lexsort((right, left))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
    group = np.empty(len(order), "int64")
    group[order] = np.cumsum(new) - 1
    totals = np.zeros(int(new.sum()), "int64")
    np.add.at(totals, group, count)
    first = order[new]
    return _told(t.column("part")[0].as_py(), parts, block, local, group, totals, least, {"lefts": lambda i: left[first[i]], "rights": lambda i: right[first[i]]})


def _dealing(parts: int):
    return lambda batches: _word_parts(batches, parts)


def _adding(add, parts: int, least: int):
    return lambda t: add(t, parts, least)


def _extending(length: int, parts: int):
    return lambda state, told: _extend(state, told, length, parts)


def _frequent(told: DataFrame, *columns: str) -> DataFrame:
    """A row per frequent phrase, of the parts' rows."""
    zipped = F.arrays_zip("gids", "totals", *columns)
    return told.where(F.col("gids").isNotNull()).select(F.explode(zipped).alias("x")).select(F.col("x.gids").alias("gid"), F.col("x.totals").alias("a"), *(F.col(f"x.{c}").alias(c) for c in columns))


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, block_words: int = BLOCK_WORDS, part_entries: int = PART_ENTRIES) -> tuple[DataFrame, list[DataFrame]]:
    """The words of each language (lang, n), and per length from 1 to
    ``longest`` the phrases that occur at least ``least`` times: gid, lang,
    words, a, firsts and lasts (frequencies of their first and last 1, 2, ...
    words), and from length 2 on the gids of their beginning (lft) and end (rgt)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = durable(texts.mapInArrow(lambda b: _to_blocks(b, longest, block_words), _BLOCKS_SQL), "phrase-blocks", rows=256)
    totals = blocks.groupBy("lang").agg(F.sum("words").alias("n"))
    entries = blocks.agg(F.sum(F.size("counts"))).first()[0] or 0

    def parts_for(n: int) -> int:
        return max(shuffle_partitions(spark), -(-n // part_entries))

    parts = parts_for(entries)
    sent = blocks.select("block", "lang", "names", "counts").mapInArrow(_dealing(parts), "block long, lang string, part int, local array<int>, names array<string>, counts array<long>")
    told = durable(sent.groupBy("part").applyInArrow(_adding(_add_words, parts, least), _TOLD), "phrase-told", rows=4)
    known = _frequent(told, "langs", "names")
    none = F.array().cast("array<long>")
    levels = [known.select("gid", F.col("langs").alias("lang"), F.array("names").alias("words"), "a", none.alias("firsts"), none.alias("lasts"))]
    state = blocks.select("block", "n", "context", "ids")
    back = None
    for length in range(1, longest):
        occurrences = known.agg(F.sum("a")).first()[0] or 0
        parts = parts_for(occurrences)
        own = told.where(F.col("block").isNotNull()).select("block", F.lit(length).alias("length"), "m", "local", "gid")
        back = own if back is None else back.unionByName(own)
        grown = state.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_extending(length, parts), _ENTRIES)
        told = durable(grown.groupBy("part").applyInArrow(_adding(_add_phrases, parts, least), _TOLD), "phrase-told", rows=4)
        known = _frequent(told, "lefts", "rights")
        left = levels[-1].select(F.col("gid").alias("lefts"), "lang", F.col("words").alias("lw"), F.col("a").alias("la"), F.col("firsts").alias("lf"))
        right = levels[-1].select(F.col("gid").alias("rights"), F.col("words").alias("rw"), F.col("a").alias("ra"), F.col("lasts").alias("rl"))
        named = known.join(left, "lefts").join(right, "rights")
        named = named.select("gid", "lang", F.concat("lw", F.slice("rw", -1, 1)).alias("words"), "a", F.concat("lf", F.array("la")).alias("firsts"), F.concat("rl", F.array("ra")).alias("lasts"), F.col("lefts").alias("lft"), F.col("rights").alias("rgt"))
        levels.append(durable(named, "phrases", slim=True))
    return totals, levels


def _worst_cut() -> Column:
    """The lowest-scoring cut: score, words before it, frequencies of both sides."""
    return F.expr("""array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
        'score', (cast(a AS decimal(20, 0)) * 2000000) div cast(firsts[k - 1] + lasts[size(words) - k - 1] AS decimal(20, 0)),
        'k', k, 'l', firsts[k - 1], 'r', lasts[size(words) - k - 1])))""")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, best: int = 2000, block_words: int = BLOCK_WORDS, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Each language's ``best`` phrases of 2 to ``longest`` words of ``docs``
    (text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces,
    those into words ``[^\\x20\\x09]+``; a phrase lies within a piece, and all its
    occurrences count, overlaps included.  The score is that of the worst cut,
    floor(2000000 a / (l + r)); equal ones: the first.  A phrase goes if a longer
    one that has it occurs at least 0.8 times as often (a phrase one word longer
    does then, too, so those alone are asked).  Order: score, a, phrase.

    A null lang is ``und``, together with a lang of that name; a null or empty
    text has no words.  Repeated rows count as often as they occur.  Long texts
    are taken in slices, and blocks may end within them.  An empty table, or one
    without frequent phrases, gives no row.  Other columns are not read."""
    if not 2 <= longest <= 8 or least < 1:
        raise ValueError("phrases have from 2 to 8 words and occur")
    totals, levels = frequent_phrases(docs, least, longest, block_words, part_entries)
    found = None
    for shorter, longer in zip(levels[1:], [*levels[2:], None], strict=True):
        rows = shorter
        if longer is not None:
            most = longer.select(F.explode(F.array_distinct(F.array("lft", "rgt"))).alias("gid"), F.col("a").alias("most")).groupBy("gid").agg(F.max("most").alias("most"))
            rows = rows.join(most, "gid", "left").where(F.col("most").isNull() | (5 * F.col("most") < 4 * F.col("a")))
        rows = rows.select("lang", F.array_join("words", " ").alias("phrase"), "a", _worst_cut().alias("cut"))
        found = rows if found is None else found.unionByName(rows)
    found = found.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    some = some.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
