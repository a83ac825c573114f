"""Packing documents into sequences of at most ``capacity`` tokens by the
linear grouping scheme.

Lengths are integers from 1 to the capacity, so everything that is optimised
is a histogram of at most ``capacity`` rows, whatever the number of documents:

1. large lengths are sorted and cut into groups of equal cardinality, each
   rounded up to its largest member;
2. over these few sizes, a linear program over configurations is solved by
   column generation (knapsack by dynamic programming) and rounded down;
3. actual lengths take the slots of their group, longest first;
4. what is left (the large ones that rounding down left over, then the small
   ones) goes best-fit, longest first, into the space that remains, then into
   new sequences.

A plan is a list of runs: ``count`` pieces of one length, taken by rank, go to
``count`` consecutive sequences at one offset.  Ranks within a length are made
in two levels (salted groups, then their offsets), so a length that holds a
third of all pieces is spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, tokenizer_path
from .tokens import MEMO, encode_texts, ids_crc32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def group_lengths(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Cut pieces, longest first, into at most ``k`` groups of equal
    cardinality: per group its (length, count) runs."""
    total = int(counts.sum())
    k = max(1, min(k, total))
    bounds = [total * (i + 1) // k for i in range(k)]
    groups: list[list[tuple[int, int]]] = [[]]
    seen = 0
    for length, n in zip(lengths[::-1].tolist(), counts[::-1].tolist(), strict=True):
        while n:
            if seen == bounds[len(groups) - 1]:
                groups.append([])
            take = min(n, bounds[len(groups) - 1] - seen)
            groups[-1].append((length, take))
            seen, n = seen + take, n - take
    return groups


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of most worth: how often each size occurs in it."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_, worth_ = sizes[order], worth[order]
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        n = np.searchsorted(sizes_, c, side="right")
        if n:
            value = best[c - sizes_[:n]] + worth_[:n]
            j = int(value.argmax())
            if value[j] > best[c] + 1e-12:
                best[c], pick[c] = value[j], j
    out, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[order[pick[c]]] += 1
            c -= int(sizes_[pick[c]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Column generation for min sum(x) with every size's demand covered:
    the configurations of the final basis and their multiplicities."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        new = _knapsack(sizes, np.maximum(dual, 0), capacity)
        if new @ dual <= 1 + 1e-6:
            break
        step = np.linalg.solve(basis, new.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = new
    return [(basis[:, j].round().astype(int), float(x[j])) for j in range(k)]


def plan(histogram: dict[int, int], capacity: int, groups: int = 48, small: float = 1 / 8) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset), sorted, and
    the number of sequences.  Lengths over ``small * capacity`` are large.
    At most ``groups`` distinct rounded sizes."""
    hist = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if any(not 1 <= k <= capacity for k in hist):
        raise ValueError("lengths must lie between 1 and the capacity")
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(hist, 0)  # ranks given out, by length
    n_seq = hist.pop(capacity, 0)
    if n_seq:
        runs.append((capacity, 0, n_seq, 0, 0))
    free: dict[int, list[tuple[int, int]]] = {}  # space left -> (first sequence, how many)
    spaces: list[int] = []

    def leave(space: int, first: int, n: int) -> None:
        if space > 0:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    def give(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n

    rest: dict[int, int] = {k: v for k, v in hist.items() if k <= small * capacity}
    large = sorted(k for k in hist if k > small * capacity)
    if large:
        grouped = group_lengths(np.array(large), np.array([hist[k] for k in large]), groups)
        sizes, demand, queues = [], [], []
        for g in grouped:  # groups of one rounded size are one size
            if sizes and sizes[-1] == g[0][0]:
                queues[-1] += g
                demand[-1] += sum(n for _, n in g)
            else:
                sizes.append(g[0][0])
                demand.append(sum(n for _, n in g))
                queues.append(list(g))
        queues = [q[::-1] for q in queues]  # longest at the end
        for slots, times in configurations(np.array(sizes), np.array(demand, float), capacity):
            m = int(times + 1e-7)
            if m <= 0:
                continue
            mine = [g for g, a in enumerate(slots) for _ in range(a)]
            while m:
                # actual lengths for the slots: as many equal copies as the runs in front allow
                need: dict[int, int] = {}
                chosen: list[int] = []
                for g in mine:
                    if len(queues[g]):
                        chosen.append(g)
                        need[g] = need.get(g, 0) + 1
                if not chosen:
                    break
                copies = 1 if any(queues[g][-1][1] < a for g, a in need.items()) else min([m] + [queues[g][-1][1] // a for g, a in need.items()])
                first, offset = n_seq, 0
                for g in chosen:
                    if not queues[g]:
                        continue  # its last piece has just gone
                    length, n = queues[g].pop()
                    give(length, copies, first, offset)
                    offset += length
                    if n > copies:
                        queues[g].append((length, n - copies))
                leave(capacity - offset, first, copies)
                n_seq += copies
                m -= copies
        for q in queues:
            for length, n in q:
                rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                full, left = divmod(n, each)
                for m, per in ((full, each), (1 if left else 0, left)):
                    if m:
                        for j in range(per):
                            give(length, m, n_seq, j * length)
                        leave(capacity - per * length, n_seq, m)
                        n_seq += m
                break
            space = spaces[at]
            first, m = free[space].pop()
            take = min(m, n)
            if take < m:
                free[space].append((first + take, m - take))
            elif not free[space]:
                del free[space]
                spaces.pop(at)
            give(length, take, first, capacity - space)
            leave(space - length, first, take)
            n -= take
    out = np.array(sorted(runs), dtype="int64").reshape(-1, 5)
    return out, n_seq


#: (groups, smallest large length as a share of the capacity), each tried.
SCHEMES = ((24, 1 / 8), (24, 1 / 4), (24, 1 / 3), (48, 1 / 3), (24, 1 / 2))


def best_plan(histogram: dict[int, int], capacity: int, schemes=SCHEMES) -> tuple[np.ndarray, int]:
    """The plan with fewest sequences over several group counts and limits of
    what counts as large; all of them work on the histogram alone."""
    bound = -(-sum(k * v for k, v in histogram.items()) // capacity)
    best = None
    for groups, small in schemes:
        found = plan(histogram, capacity, groups, small)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] == bound:
            break
    return best


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int | None = 0, memo: int = MEMO) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces:
    whole if it has at most ``capacity`` ids, else cut every ``capacity``.
    A null text is empty; a document without ids at all gives no piece."""
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 1024):
                rows = []
                own, texts = (b.column(c)[lo : lo + 1024].to_pylist() for c in ("doc_id", "text"))
                for doc_id, ids in zip(own, encode_texts(texts, path, memo), strict=True):
                    if end_id is not None:
                        ids = np.concatenate([ids, np.array([end_id], ids.dtype)])
                    for j, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        rows.append((doc_id, j, at, len(part), ids_crc32(part)))
                if rows:
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack(sized: DataFrame, capacity: int = 2048, schemes=SCHEMES, rows_per_salt: int = 20_000) -> DataFrame:
    """Place rows of (doc_id, piece, ..., length) into sequences: adds
    ``sequence_id`` and ``offset``.  Rows must have lengths from 1 to
    ``capacity``; equal rows are placed apart; an empty table stays empty.

    The histogram and the plan have a size bounded by the capacity alone; the
    plan goes to the executors with the function.
    """
    hist = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = best_plan(hist, capacity, schemes)
    width = max(hist.values(), default=0) + 1
    keys = runs[:, 0] * width + runs[:, 1]
    salts = max(64, max(hist.values(), default=0) // rows_per_salt)
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", *(c for c in ("ids_crc32",) if c in sized.columns)), F.lit(salts)).cast("int"))
    base = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    base = base.select("length", "_salt", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = W.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(own).cast("long") - 1).join(base, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).select(*sized.columns, "_rank")
    columns = list(sized.columns)
    schema = ", ".join(f"`{n}` {t}" for n, t in sized.dtypes) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * width + rank, side="right") - 1
            run = runs[at]
            seq, off = run[:, 3] + rank - run[:, 1], run[:, 4]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(seq), pa.array(off)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int | None = 0, schemes=SCHEMES, memo: int = MEMO) -> DataFrame:
    """Tokenise, cut and pack every whole text of ``docs`` (doc_id, text).
    Null text: empty (its end id alone).  Rows that share an id keep their own
    pieces.  Other columns are ignored.  The pieces, without their ids, are
    written once to the shared folder."""
    return pack(durable(pieces(docs, capacity, tokenizer, end_id, memo), "pieces"), capacity, schemes)
