"""Removal of repeated blocks: exact by fingerprint, near by SimHash.

Order is (rel_path, pos) throughout: the first of equal blocks stays, and a
near block goes only because of an earlier block that stays itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import durable
from .graph import components

try:  # the interpreter's own: OpenSSL's set-up costs more than a shingle's digest
    from _md5 import md5
except ImportError:
    from hashlib import md5


def blocks(docs: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """(rel_path, pos, block, words, fp) of every non-empty block of (rel_path, text)."""
    b = docs.select("rel_path", F.posexplode(T.blocks(F.col("text"), delimiter)).alias("pos", "block"))
    norm = T.normalised(F.col("block"))
    return b.withColumn("words", T.squeezed_words(norm)).withColumn("fp", F.md5(norm.cast("binary")))


def first_of_equal(found: DataFrame, least_words: int = T.MIN_BLOCK_WORDS) -> DataFrame:
    """Adds ``repeat``: an earlier long block has the same fingerprint.  The
    first place per fingerprint is a partial aggregate, so a block that is on
    every page costs one row per task."""
    place = F.struct("rel_path", "pos")
    long_ = found.where(F.col("words") >= least_words)
    first = long_.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select("fp", "first")
    joined = found.join(first, "fp", "left")
    return joined.withColumn("repeat", F.coalesce((F.col("words") >= least_words) & (place > F.col("first")), F.lit(False))).drop("first")


def simhash(rows: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """Key columns and ``simhash`` of each row with a text: a bit is set where
    more hashes of its three-word shingles have it than not.  One Arrow pass:
    neither a row per shingle nor a shuffle."""
    keys = [key] if isinstance(key, str) else key
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], pa.array(simhashes(part.column(text).to_pylist()))], names=[*keys, "simhash"])

    found = rows.where(F.col(text).isNotNull()).select(*keys, *([] if text in keys else [text]))
    return found.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", simhash long")


def simhashes(texts: list[str]) -> np.ndarray:
    """SimHash of each text; shingles are cut from its bytes, equal texts are hashed once."""
    out = np.zeros(len(texts), "int64")
    known: dict[str, int] = {}
    for i, text in enumerate(texts):
        if text in known:
            out[i] = known[text]
            continue
        raw = " ".join(text.split()).encode("utf-8", "surrogatepass")
        blanks = np.flatnonzero(np.frombuffer(raw, "uint8") == 32).tolist()
        if len(blanks) + 1 >= T.SHINGLE:
            found = [raw[a:b] for a, b in zip([0, *(j + 1 for j in blanks)], [*blanks[T.SHINGLE - 1 :], len(raw)])]
        else:
            found = [text.encode("utf-8", "surrogatepass")]
        bits = np.frombuffer(b"".join([md5(x).digest()[:8] for x in found]), "uint8")
        ones = np.zeros(64, "int64")
        for at in range(0, len(bits), 1 << 20):  # a long text's bits in parts
            ones += np.unpackbits(bits[at : at + (1 << 20)].reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
        out[i] = known[text] = np.packbits(2 * ones > len(found)).view(">i8")[0]
    return out


@dataclass(frozen=True)
class Plan:
    """How near hashes meet: in cells of equal bits under a mask, where one of
    them may also be in the cells of the keys that are ``radius`` (0 or 1) bits
    away; or, without masks, as all pairs of ``blocks`` blocks."""

    masks: tuple[int, ...] = ()
    radius: int = 0
    blocks: int = 1

    def rows(self) -> int:
        """Rows that a hash is in at most."""
        return self.blocks if not self.masks else len(self.masks) + self.radius * sum(1 + m.bit_count() for m in self.masks)


#: Hashes of a block of the all-pairs plan, and members of a cell that a task takes whole.
BLOCK, CELL = 1 << 16, 1 << 13
#: Blocks are smaller than that where there would be fewer than MANY, but not below FEW hashes.
MANY, FEW = 24, 1 << 12
#: Hashes of one block that are compared with so many of another at once.
ROWS, COLUMNS = 4, 1 << 13
#: What comparing two hashes costs, in rows that are dealt, both estimates: of a cell, where each pair's places are gathered, and in blocks
#: (1.6 ns measured).  With one cost for both, 16 bits went to cells from some 180,000 hashes on, with about half of all pairs gathered.
PAIR_COST, BLOCK_PAIR_COST = 0.001, 0.0001


def _slices(m: int) -> list[int]:
    cuts = [64 * j // m for j in range(m + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]


def plan_for(n: int, k: int) -> Plan:
    """The plan with the least estimated work for n evenly spread hashes.  Two
    hashes within k bits agree on m-k of m slices; of k // 2 + 1 slices they
    differ by at most one bit in one; and in blocks all pairs are compared."""
    found = [Plan((), 0, max(1, -(-n // BLOCK)))]
    for m in range(k + 1, min(64, k + 4) + 1):
        slices = _slices(m)
        if comb(m, m - k) <= 64:
            found.append(Plan(tuple(reduce(or_, c) for c in combinations(slices, m - k))))
    found.append(Plan(tuple(_slices(k // 2 + 1)), 1))

    def cost(p: Plan) -> float:
        if not p.masks:
            return p.rows() + BLOCK_PAIR_COST * n
        pairs = n * sum((1 + p.radius * m.bit_count()) / 2.0 ** m.bit_count() for m in p.masks)
        return p.rows() + PAIR_COST * pairs

    return min(found, key=cost)


_PAIRS = "a long, b long, distance int"


def _near(batches: Iterator[pa.RecordBatch], plan: Plan, k: int) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows (h, own, cell, part, x, y) that lie together by cell,
    own rows first.  A pair comes from the first mask under which it meets, once."""
    masks = np.array(plan.masks, "uint64")

    def pairs(h: np.ndarray, own: np.ndarray, cell: np.ndarray, one: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, lag = np.flatnonzero(own | one if not plan.radius else own), 1
        while len(at := at[at + lag < ends[at]]):
            for lo in range(0, len(at), 1 << 20):
                i = at[lo : lo + (1 << 20)]
                j = i + lag
                u, v = h[i].view("uint64"), h[j].view("uint64")
                near = np.bitwise_count(u ^ v) <= k
                near &= (own[i] != own[j]) & (h[i] < h[j]) if plan.radius else one[i] | (own[i] != own[j])
                i, j, u, v = i[near], j[near], u[near], v[near]
                if len(i):
                    x, c, first = u ^ v, cell[i], np.ones(len(i), bool)
                    for n, m in enumerate(masks[:-1]):
                        first &= (c <= n) | (np.bitwise_count(x & m) > plan.radius)
                    a, b, x = h[i][first], h[j][first], x[first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.bitwise_count(x).astype("int32"))], names=["a", "b", "distance"])
            lag += 1

    held: dict[str, np.ndarray] | None = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            new = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "own", "cell", "part", "x", "y")}
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        if held is None or not len(held["h"]):
            continue
        change = np.zeros(len(held["h"]), bool)
        for c in ("cell", "part", "x", "y"):
            change[1:] |= held[c][1:] != held[c][:-1]
        starts = np.r_[0, np.flatnonzero(change)]
        done = len(held["h"]) if b is None else starts[-1]  # the last cell may go on
        if done:
            bounds = np.r_[starts[starts < done], done]
            ends = np.repeat(bounds[1:], np.diff(bounds))
            yield from pairs(*(held[c][:done] for c in ("h", "own", "cell")), held["x"][:done] == held["y"][:done], ends)
            held = {c: v[done:] for c, v in held.items()}


def _close(left: np.ndarray, right: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs within ``k`` bits, i < j where both are one array.
    Tiles that stay in the processor's cache, in arrays that are made once: the
    work is the square of the blocks, so what a pair costs is what counts."""
    one = left is right
    x, n, near = np.empty((ROWS, COLUMNS), "uint64"), np.empty((ROWS, COLUMNS), "uint8"), np.empty((ROWS, COLUMNS), bool)
    for at in range(0, len(right), COLUMNS):
        v = right[None, at : at + COLUMNS]
        for lo in range(0, min(len(left), at + COLUMNS) if one else len(left), ROWS):
            u = left[lo : lo + ROWS, None]
            its = np.s_[: u.shape[0], : v.shape[1]]
            np.less_equal(np.bitwise_count(np.bitwise_xor(u, v, out=x[its]), out=n[its]), k, out=near[its])
            i, j = np.divmod(np.flatnonzero(near[its]), v.shape[1])
            i, j = i + lo, j + at
            yield (i[i < j], j[i < j]) if one else (i, j)


def _block_pairs(hashes: DataFrame, n: int, k: int) -> DataFrame:
    """All pairs of ``n`` blocks, each compared by one task."""
    block = F.pmod(F.xxhash64("h"), F.lit(n)).cast("int")
    dealt = hashes.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.select("h", F.least("_b", "_o").cast("int").alias("x"), F.greatest("_b", "_o").cast("int").alias("y"), (F.col("_b") <= F.col("_o")).alias("own"))
    dealt = dealt.repartition(n * (n + 1), "x", "y")  # small in bytes, not in work: none are put together

    def compare(t: pa.Table) -> pa.Table:
        h, own, one = t.column("h").to_numpy(), t.column("own").to_numpy(), t.column("x")[0].as_py() == t.column("y")[0].as_py()
        left, right = (h, h) if one else (h[own], h[~own])
        u = left.view("uint64")
        found = [(left[i], right[j]) for i, j in _close(u, u if one else right.view("uint64"), k) if len(i)]
        a, b = (np.concatenate(x) for x in zip(*found)) if found else np.empty((2, 0), "int64")
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "distance": pa.array(np.bitwise_count((a ^ b).view("uint64")).astype("int32"))})

    return dealt.groupBy("x", "y").applyInArrow(compare, _PAIRS)


def near_pairs(hashes: DataFrame, k: int = 3, hash_col: str = "simhash", plan: Plan | None = None) -> DataFrame:
    """(a, b, distance) of distinct hash values a < b within ``k`` bits; null
    hashes are near nothing.  From 64 bits on everything is near: an error.

    Hashes meet by the plan for their number and distance (``plan_for``); cells
    that many share are cut into blocks, of which every two meet; tasks compare
    what meets in numpy, so only near pairs become rows, each once.  At k = 3
    a hash is in a few rows, at 8 in some 70, and where distances are so large
    that no key rules anything out (16 of 64 bits) in one per block of 65536."""
    if not 0 <= k < 64:
        raise ValueError("the distance must be from 0 to 63 bits")
    distinct = durable(hashes.select(F.col(hash_col).alias("h")).where(F.col(hash_col).isNotNull()).distinct(), "simhashes")
    count = distinct.count()
    p = plan or plan_for(count, k)
    if not p.masks:
        return _block_pairs(distinct, max(p.blocks, min(MANY, -(-count // FEW))), k)

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    keys = []
    for i, m in enumerate(p.masks):
        masked = F.col("h").bitwiseAND(F.lit(signed(m)).cast("long"))
        keys.append(F.struct(F.lit(True).alias("own"), F.lit(i).alias("cell"), masked.alias("part")))
        if p.radius:
            bits = [0, *(1 << j for j in range(64) if m >> j & 1)]
            keys += [F.struct(F.lit(False).alias("own"), F.lit(i).alias("cell"), masked.bitwiseXOR(F.lit(signed(x)).cast("long")).alias("part")) for x in bits]
    celled = distinct.select("h", F.inline(F.array(*keys)))
    # cells of many members: blocks of each side, every two of which meet
    large = celled.groupBy("cell", "part").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    celled = celled.join(large, ["cell", "part"], "left").withColumn("_n", F.ceil(F.coalesce("n", F.lit(1)) / CELL).cast("int"))
    b = F.pmod(F.xxhash64("h"), F.col("_n")).cast("int")
    other = celled.withColumn("_b", b).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    if p.radius:
        own, x, y = F.col("own"), F.when(F.col("own"), F.col("_b")).otherwise(F.col("_o")), F.when(F.col("own"), F.col("_o")).otherwise(F.col("_b"))
    else:
        own, x, y = F.col("_b") <= F.col("_o"), F.least("_b", "_o"), F.greatest("_b", "_o")
    dealt = other.select("h", own.alias("own"), "cell", "part", x.alias("x"), y.alias("y"))
    dealt = dealt.repartition("cell", "part", "x", "y").sortWithinPartitions("cell", "part", "x", "y", F.desc("own"))
    return dealt.mapInArrow(lambda batches: _near(batches, p, k), _PAIRS)


#: Edges of the greedy rule that one task decides.
FEW_EDGES = 2_000_000


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: (id, and place where there is one), edges: (a, b) with a placed
    before b.  Returns the ids that go: a node goes when an earlier neighbour
    stays, and stays when all earlier neighbours go.

    Where there are many edges their components are found first (rounds by the
    logarithm of their length); each one of at most ``FEW_EDGES`` edges is
    decided whole by a task.  A larger one is cut by place into ranges of so
    many edges; a task decides all of its range that does not wait for another,
    so there are as many rounds as ranges wait for each other, however long the
    chains within them are."""
    open_ = durable(edges.select("a", "b").distinct(), "greedy")
    total = open_.count()
    if not total:
        return nodes.select("id").limit(0)
    if total <= FEW_EDGES:
        return _decide(open_.coalesce(1))
    of = components(open_).select(F.col("node").alias("b"), "component")
    tagged = durable(open_.join(of, "b"), "greedy-components")
    held = durable(tagged.groupBy("component").agg(F.count("*").alias("n")), "greedy-sizes")
    giants = held.where(F.col("n") > FEW_EDGES)
    small = tagged.join(giants, "component", "left_anti")
    gone = durable(_decide(small.repartition(-(-total // max(1, FEW_EDGES)), "component").select("a", "b")), "greedy-gone")
    rest = tagged.join(giants, "component", "left_semi").select("a", "b")
    if giants.isEmpty():
        return gone
    return gone.unionByName(_by_ranges(nodes, durable(rest, "greedy-giants"), total))


def _decide(edges: DataFrame) -> DataFrame:
    """The nodes that go; every component lies within one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        ids = decided(*(np.concatenate(x) for x in zip(*got, strict=True))) if got else np.empty(0, "int64")
        yield pa.RecordBatch.from_arrays([pa.array(ids)], names=["id"])

    return durable(edges.mapInArrow(run, "id long"), "greedy-gone")


def _by_ranges(nodes: DataFrame, edges: DataFrame, total: int) -> DataFrame:
    """The nodes that go, of edges too many for one task: ranges of later nodes
    by place, in rounds."""
    place = F.col("place") if "place" in nodes.columns else F.col("id")
    later = edges.join(nodes.select(F.col("id").alias("b"), place.alias("_p")), "b")
    parts = -(-total // max(1, FEW_EDGES // 2))
    ranged = durable(later.repartitionByRange(parts, "_p").select("a", "b", F.spark_partition_id().alias("part")), "greedy-ranges")
    inner = ranged.select(F.col("b").alias("a"), F.col("part").alias("home")).distinct()
    # earlier nodes that are nobody's later one stay; others are decided in their range
    open_ = durable(ranged.join(inner, "a", "left").select("a", "b", "part", "home", F.when(F.col("home").isNull(), F.lit(True)).alias("stays")), "greedy-open")
    gone = None
    while True:

        def run(t: pa.Table) -> pa.Table:
            a, b, part = (t.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "part"))
            home, stays = (t.column(c).to_pylist() for c in ("home", "stays"))
            known = {x: s for x, s in zip(a.tolist(), stays, strict=True) if s is not None}
            found = settled(a, b, known, {x for x, h in zip(a.tolist(), home, strict=True) if h is not None and h != part[0]})
            return pa.table({"id": pa.array(list(found), pa.int64()), "stays": pa.array(list(found.values()), pa.bool_())})

        now = durable(open_.groupBy("part").applyInArrow(run, "id long, stays boolean"), "greedy-settled")
        if now.isEmpty():
            break
        fresh = now.where(~F.col("stays")).select("id")
        gone = fresh if gone is None else gone.unionByName(fresh)
        rest = open_.join(now.select(F.col("id").alias("b")), "b", "left_anti")
        told = now.select(F.col("id").alias("a"), F.col("stays").alias("_s"))
        open_ = durable(rest.join(told, "a", "left").select("a", "b", "part", "home", F.coalesce("stays", "_s").alias("stays")), "greedy-open")
    return gone if gone is not None else nodes.select("id").limit(0)


def settled(a: np.ndarray, b: np.ndarray, known: dict[int, bool], foreign: set[int]) -> dict[int, bool]:
    """Whether later nodes stay, of those that can be told: ``known`` are
    earlier nodes' answers, ``foreign`` ones may still be open elsewhere."""
    later: dict[int, list[int]] = {}
    waits: dict[int, int] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        later.setdefault(x, []).append(y)
        waits[y] = waits.get(y, 0) + 1
    answer, ready = dict(known), list(known)
    for x in later:  # what waits for nobody stays
        if x not in waits and x not in answer and x not in foreign:
            answer[x] = True
            ready.append(x)
    found: dict[int, bool] = {}
    while ready:
        x = ready.pop()
        for y in later.get(x, ()):
            waits[y] -= 1
            if y not in found and (answer[x] or not waits[y]):
                found[y] = answer[y] = not answer[x]
                ready.append(y)
    return found


def decided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The nodes that go, of edges from earlier to later nodes."""
    return np.array(sorted(x for x, stays in settled(a, b, {}, set()).items() if not stays), "int64")


def deduplicate(docs: DataFrame, mode: str = "both", k: int = 3, delimiter: str = "\n\n", least_words: int = T.MIN_BLOCK_WORDS) -> DataFrame:
    """Every block of (rel_path, text) with ``removed``: 'exact', 'fuzzy' or
    null.  Blocks under ``least_words`` always stay and stand for none."""
    found = durable(blocks(docs, delimiter), "blocks")
    marked = first_of_equal(found, least_words) if mode in ("exact", "both") else found.withColumn("repeat", F.lit(False))
    if mode not in ("fuzzy", "both"):
        return marked.withColumn("removed", F.when(F.col("repeat"), "exact")).drop("repeat")
    marked = durable(marked, "blocks-marked")
    rest = marked.where(~F.col("repeat") & (F.col("words") >= least_words)).withColumn("norm", T.normalised(F.col("block")))
    hashed = durable(simhash(rest, ["rel_path", "pos"], "norm"), "block-hashes")
    # blocks of one hash: the first stands for all, the others go with distance 0 wherever it stays or not
    first = hashed.groupBy("simhash").agg(F.min(F.struct("rel_path", "pos")).alias("place"))
    near = near_pairs(hashed, k)
    at = first.select(F.col("simhash").alias("a"), F.col("place").alias("pa"))
    to = first.select(F.col("simhash").alias("b"), F.col("place").alias("pb"))
    e = near.join(at, "a").join(to, "b")
    swap = F.col("pa") < F.col("pb")
    edges = e.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("b"))
    gone = first_independent(first.select(F.col("simhash").alias("id"), "place"), edges).withColumnRenamed("id", "simhash").withColumn("gone", F.lit(True))
    state = hashed.join(first, "simhash").join(gone.distinct(), "simhash", "left")
    fuzzy = F.coalesce(F.col("gone"), F.lit(False)) | (F.struct("rel_path", "pos") != F.col("place"))
    state = state.select("rel_path", "pos", fuzzy.alias("fuzzy"))
    out = marked.join(state, ["rel_path", "pos"], "left")
    return out.withColumn("removed", F.when(F.col("repeat"), "exact").when(F.col("fuzzy"), "fuzzy")).drop("repeat", "fuzzy")


def texts(marked: DataFrame) -> DataFrame:
    """(rel_path, text): the blocks that stay, in order, an empty line between.
    A document whose blocks all go keeps an empty text."""
    kept = F.collect_list(F.when(F.col("removed").isNull(), F.struct("pos", "block")))
    return marked.groupBy("rel_path").agg(F.array_join(F.transform(F.array_sort(kept), lambda x: x["block"]), "\n\n").alias("text"))


def stats(marked: DataFrame) -> DataFrame:
    """One row: blocks in all, removed either way, and words removed."""
    def n(kind: str) -> Column:
        return F.count_if(F.col("removed") == kind)

    return marked.agg(
        F.count("*").alias("total_blocks"),
        n("exact").alias("removed_exact"),
        n("fuzzy").alias("removed_fuzzy"),
        F.coalesce(F.sum(F.when(F.col("removed").isNotNull(), F.col("words"))), F.lit(0)).alias("words_removed"),
    )


__all__ = ["blocks", "deduplicate", "first_independent", "first_of_equal", "near_pairs", "plan_for", "simhash", "stats", "texts"]
