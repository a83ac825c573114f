"""Features of rolling time windows: counts, sums, distinct languages and exact
quantiles of the rows of one group in the last W seconds.

Rows are first added up per (group, time, value, language), so an id or a
moment that holds a third of all rows is a few counted rows.  Time is cut into
cells as long as the longest window; a row goes to its own cell and to those
that windows reach back from.  Cells are dealt in ranges of equal size, each is
sorted by time, and a task sweeps through its cells with two pointers a window:
rows enter at one end and leave at the other.  A quantile is kept by two heaps
of counted values, parted at its rank: values that leave become tombstones,
which go when they surface or outnumber the living, and values move between the
heaps as the rank changes.  Languages are counted references.

What a task holds is the content of one longest window, in distinct values.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Seconds that windows reach back, and quantiles as (column, numerator, denominator).
WINDOWS = (3600, 21600)
QUANTILES = (("median_chars", 1, 2), ("high_chars", 75, 100))


class _Heap:
    """Counted values, the first on top; ``sign`` -1: the largest first."""

    def __init__(self, sign: int):
        self.sign, self.order, self.counts, self.dead, self.total = sign, [], {}, 0, 0

    def add(self, v: int, n: int) -> None:
        held = self.counts.get(v)
        if held is None:
            heappush(self.order, self.sign * v)
            self.counts[v] = n
        else:
            self.dead -= held == 0
            self.counts[v] = held + n
        self.total += n

    def take(self, v: int, n: int) -> int:
        """Remove up to ``n`` of a value; how many there were."""
        held = self.counts.get(v, 0)
        if not held:
            return 0
        got = min(held, n)
        self.counts[v] = held - got
        self.total -= got
        if held == got:
            self.dead += 1  # a tombstone
            if self.dead > 64 and 2 * self.dead > len(self.order):
                self.counts = {k: c for k, c in self.counts.items() if c}
                self.order = [self.sign * k for k in self.counts]
                heapify(self.order)
                self.dead = 0
        return got

    def top(self) -> int | None:
        while self.order:
            v = self.sign * self.order[0]
            if self.counts[v]:
                return v
            heappop(self.order)
            del self.counts[v]
            self.dead -= 1
        return None


class Quantile:
    """The value of rank ceil(num * m / den) of m values that come and go."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.high = _Heap(-1), _Heap(1)

    def add(self, v: int, n: int) -> None:
        most = self.low.top()
        (self.low if most is not None and v <= most else self.high).add(v, n)

    def remove(self, v: int, n: int) -> None:
        n -= self.high.take(v, n)
        if n:
            self.low.take(v, n)

    def value(self) -> int | None:
        low, high = self.low, self.high
        rank = -(-self.num * (low.total + high.total) // self.den)
        while low.total < rank:
            v = high.top()
            low.add(v, high.take(v, rank - low.total))
        while low.total > rank:
            v = low.top()
            high.add(v, low.take(v, low.total - rank))
        return low.top()


class _Window:
    """The rows of the last ``back`` seconds before a moment."""

    def __init__(self, back: int, quantiles: tuple):
        self.back, self.rows = back, deque()
        self.events, self.sum, self.tags = 0, 0, {}
        self.quantiles = [Quantile(num, den) for _, num, den in quantiles]

    def enter(self, row: tuple) -> None:
        _, v, tag, n = row
        self.rows.append(row)
        self.events += n
        if tag is not None:
            self.tags[tag] = self.tags.get(tag, 0) + n
        if v is not None:
            self.sum += v * n
            for q in self.quantiles:
                q.add(v, n)

    def leave(self, before: int) -> None:
        rows = self.rows
        while rows and rows[0][0] < before:
            _, v, tag, n = rows.popleft()
            self.events -= n
            if tag is not None:
                left = self.tags[tag] - n
                if left:
                    self.tags[tag] = left
                else:
                    del self.tags[tag]
            if v is not None:
                self.sum -= v * n
                for q in self.quantiles:
                    q.remove(v, n)

    def facts(self, at: int) -> list:
        self.leave(at - self.back)
        return [self.events, self.sum, len(self.tags), *(q.value() for q in self.quantiles)]


class _Sweep:
    """One cell of one group: moments in order of time."""

    def __init__(self, first: int, windows: tuple, quantiles: tuple):
        self.first, self.windows = first, [_Window(w, quantiles) for w in windows]
        self.at, self.now = None, []

    def see(self, row: tuple) -> list | None:
        """A row in order of time; the facts of a moment of the cell itself that begins with it."""
        t = row[0]
        found = None
        if t != self.at:
            self._pass(t)
            self.at = t
            if t >= self.first:
                found = [x for w in self.windows for x in w.facts(t)]
        self.now.append(row)
        return found

    def _pass(self, t: int) -> None:
        """The moment before is over: its rows may be in windows from now on."""
        for w in self.windows:
            w.leave(t - w.back)
            if self.at is not None and self.at >= t - w.back:
                for row in self.now:
                    w.enter(row)
        self.now = []


def _columns(windows: tuple, quantiles: tuple) -> list[str]:
    return [f"{c}_{i}" for i in range(len(windows)) for c in ("events", "sum", "tags", *(f"q{j}" for j in range(len(quantiles))))]


def sweep_cells(dealt: DataFrame, windows: tuple, quantiles: tuple, cell_s: int) -> DataFrame:
    """(grp, t, a column per window and fact) of every moment, of rows (grp,
    cell, t, v, tag, n) that lie together by (grp, cell) in order of t."""
    columns = _columns(windows, quantiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sweep = None, None
        for b in batches:
            groups, times, facts = [], [], []
            for grp, cell, *row in zip(*(b.column(c).to_pylist() for c in ("grp", "cell", "t", "v", "tag", "n")), strict=True):
                if key != (grp, cell):
                    key, sweep = (grp, cell), _Sweep(cell * cell_s, windows, quantiles)
                found = sweep.see(tuple(row))
                if found is not None:
                    groups.append(grp)
                    times.append(row[0])
                    facts.append(found)
            if facts:
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(times, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*facts, strict=True))], names=["grp", "t", *columns])

    return dealt.mapInArrow(run, "grp string, t long, " + ", ".join(f"{c} long" for c in columns))


def _div(x: Column, by: int) -> Column:
    """A multiple of ``by``, divided: exact for any long."""
    return (x.cast("decimal(20,0)") / F.lit(by).cast("decimal(10,0)")).cast("long")


def _cell(t: Column, cell_s: int) -> Column:
    return _div(t - F.pmod(t, F.lit(cell_s).cast("long")), cell_s)


def event_time(doc_id: Column, spread: int = 4000, per_minute: int = 6) -> Column:
    """60 * floor((id + crc32(id) mod spread) / per_minute); null without an id
    or where that is no long."""
    x = F.try_add(doc_id.cast("long"), F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(spread)))
    return F.try_multiply(F.lit(60).cast("long"), _div(x - F.pmod(x, F.lit(per_minute).cast("long")), per_minute))


def rolling_features(docs: DataFrame, windows: tuple[int, ...] = WINDOWS, quantiles: tuple = QUANTILES, keep: tuple[str, ...] = ("doc_id",), time: Column | None = None, cell_s: int | None = None) -> DataFrame:
    """``keep`` columns of every row of ``docs`` (doc_id, source, lang, text),
    once per window W, with window_s (W), event_s (the row's time) and, of all
    rows of its source with event_s - W <= their time < event_s: n_events,
    sum_chars (code points; none: 0), n_langs (distinct languages) and the
    quantiles of the code points, whose rank is rounded up.

    ``time``: the row's time in whole seconds, by default from its id.  A null
    source is a source.  A null text has no length but is an event; an empty one
    has length 0.  A row without time (null id) is in no window and its own are
    empty: counts 0, quantiles null.  Rows that share a time are not in each
    other's windows; repeated rows and ids count as often as they occur.  Equal
    lengths are separate values of one rank each.  Texts are only measured,
    however long.  An empty table gives no row.  Other columns are not read;
    ``keep`` may not hold a name of the result."""
    names = ["window_s", "event_s", "n_events", "sum_chars", "n_langs", *(q[0] for q in quantiles)]
    if taken := sorted({*names} & {*keep}):
        raise ValueError(f"columns of the result: {', '.join(taken)}")
    if not windows or min(windows) <= 0:
        raise ValueError("windows must be longer than nothing")
    cell_s = cell_s or max(windows)
    when = event_time(F.col("doc_id")) if time is None else time.cast("long")
    slim = docs.select(F.struct(*keep).alias("keep"), F.col("source").cast("string").alias("grp"), when.alias("t"), F.length("text").cast("long").alias("v"), F.col("lang").cast("string").alias("tag"))
    slim = durable(slim, "window-rows", slim=True)
    seen = slim.where(F.col("t").isNotNull()).groupBy("grp", "t", "v", "tag").agg(F.count("*").alias("n"))
    cells = F.sequence(_cell(F.col("t"), cell_s), _cell(F.col("t") + max(windows), cell_s))
    dealt = seen.withColumn("cell", F.explode(cells))
    dealt = dealt.repartitionByRange("grp", "cell").sortWithinPartitions("grp", "cell", "t")
    facts = durable(sweep_cells(dealt, windows, quantiles, cell_s), "window-facts", slim=True)
    facts = facts.select(F.col("grp").alias("_g"), F.col("t").alias("_t"), *_columns(windows, quantiles))
    found = slim.select("keep", "grp", "t").join(facts, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("t") == F.col("_t")), "left")
    zero = F.lit(0).cast("long")
    per_window = [
        F.struct(F.lit(w).cast("long").alias("window_s"), F.col("t").alias("event_s"), *(F.coalesce(F.col(f"{c}_{i}"), zero).alias(n) for c, n in (("events", "n_events"), ("sum", "sum_chars"), ("tags", "n_langs"))), *(F.col(f"q{j}_{i}").alias(q[0]) for j, q in enumerate(quantiles)))
        for i, w in enumerate(windows)
    ]
    return found.select("keep.*", F.explode(F.array(*per_window)).alias("w")).select(*keep, *(f"w.{n}" for n in names))
