"""Near hashes at every distance, and the greedy rule on long chains."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import dedup
from corpusflow.operators.dedup import Plan, _close, _slices, near_pairs, plan_for, settled
from corpusflow.operators.graph import components


def hashes(seed, n=300):
    """Spread ones, and families whose members are few bits from each other."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        h = r.getrandbits(64)
        out.append(h)
        for _ in range(r.choice([0, 0, 1, 5])):
            out.append(h ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 18))))
    return sorted({x - (1 << 64) if x >> 63 else x for x in out})


def all_pairs(h, k):
    x = np.array(h, "int64").view("uint64")
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    return {(h[i], h[j], int(d[i, j])) for i, j in zip(*np.nonzero(d <= k)) if i < j}


PLANS = [
    (3, Plan(tuple(_slices(4)))),
    (8, Plan(tuple(_slices(9)))),
    (8, Plan(tuple(_slices(5)), 1)),
    (15, Plan(tuple(_slices(8)), 1)),
    (16, Plan(tuple(_slices(9)), 1)),
    (16, Plan((), 0, 1)),
    (16, Plan((), 0, 5)),
]


@pytest.mark.parametrize("k,plan", PLANS)
@pytest.mark.parametrize("cell", [8192, 7])
def test_every_plan_finds_all_pairs_once(spark, monkeypatch, k, plan, cell):
    monkeypatch.setattr(dedup, "CELL", cell)
    h = hashes(k)
    got = [tuple(r) for r in near_pairs(spark.createDataFrame([(x,) for x in [*h, *h[:9], None]], "simhash long"), k, plan=plan).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(h, k) and got


@pytest.mark.parametrize("n", [100, 10**5, 10**6, 10**7, 10**8])
@pytest.mark.parametrize("k", [0, 3, 5, 8, 11, 16, 24])
def test_plans_keep_rows_few(n, k):
    p = plan_for(n, k)
    assert p.rows() <= max(100, n // dedup.BLOCK + 1)
    if k <= 8 and n >= 10**6:
        assert p.masks


def greedy(edges, n):
    before = {}
    for a, b in edges:
        before.setdefault(b, []).append(a)
    gone = set()
    for b in range(n):
        if any(a not in gone for a in before.get(b, ())):
            gone.add(b)
    return gone


def rounds_of(spark, monkeypatch, edges, n, few):
    """The nodes that go, and how many rounds of ranges that took."""
    names = []
    kept = dedup.durable
    monkeypatch.setattr(dedup, "durable", lambda df, name: (names.append(name), kept(df, name))[1])
    monkeypatch.setattr(dedup, "FEW_EDGES", few)
    nodes = spark.range(n).select("id", F.col("id").alias("place"))
    got = {r.id for r in dedup.first_independent(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    return got, names.count("greedy-settled")


def test_a_chain_is_not_as_many_rounds(spark, monkeypatch):
    """A chain far above the limit of a task, with links that skip one node."""
    n = 400
    edges = [(i, i + 1) for i in range(n - 1)] + [(i, i + 2) for i in range(0, n - 2, 3)]
    got, rounds = rounds_of(spark, monkeypatch, edges, n, 250)
    assert got == greedy(edges, n) and rounds <= 8


def test_small_components_take_no_rounds(spark, monkeypatch):
    r = random.Random(2)
    edges = [tuple(sorted(r.sample(range(20 * c, 20 * c + 20), 2))) for c in range(20) for _ in range(25)]
    got, rounds = rounds_of(spark, monkeypatch, edges, 400, 200)
    assert got == greedy(edges, 400) and rounds == 0


def test_giants_and_small_ones(spark, monkeypatch):
    r = random.Random(5)
    edges = [tuple(sorted(r.sample(range(400), 2))) for _ in range(900)] + [tuple(sorted(r.sample(range(400 + 9 * c, 409 + 9 * c), 2))) for c in range(50) for _ in range(6)]
    got, rounds = rounds_of(spark, monkeypatch, edges, 900, 300)
    assert got == greedy(edges, 900) and 0 < rounds <= 8


@pytest.mark.parametrize("seed", range(5))
def test_settled_by_parts(seed):
    """Parts that tell each other their answers agree with the whole."""
    r = random.Random(seed)
    edges = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(140)})
    later = {b for _, b in edges}
    part = {b: b // 20 for b in later}
    known = {a: True for a, _ in edges if a not in later}
    for _ in range(4):
        for p in range(3):
            mine = [(a, b) for a, b in edges if part[b] == p and b not in known]
            foreign = {a for a, _ in mine if a in part and part[a] != p and a not in known}
            got = settled(np.array([a for a, _ in mine]), np.array([b for _, b in mine]), {a: known[a] for a, _ in mine if a in known}, foreign)
            known |= got
    assert {b for b in later if not known[b]} == greedy(edges, 60) and later <= set(known)


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    """A chain in the order of its numbers, whose links shrink to a fraction a round."""
    from corpusflow.operators import graph

    names, kept = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, name: (names.append(name), kept(df, name))[1])
    got = {r.node: r.component for r in components(spark.createDataFrame([(i, i + 1) for i in range(5, 700)], "a long, b long")).collect()}
    assert got == {i: 5 for i in range(5, 701)} and names.count("firsts") <= 7


def test_components(spark):
    got = {r.node: r.component for r in components(spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (7, 7)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 90, 90: 90}


def test_simhashes_are_those_of_the_shingles():
    """Odd white space, few words, equal texts; shingles are no strings any more."""
    from hashlib import md5

    def plain(text):
        w = text.split()
        found = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [text]
        raw = [int.from_bytes(md5(x.encode("utf-8", "surrogatepass")).digest()[:8]) for x in found]
        h = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in raw) > len(raw))
        return h - (1 << 64) if h >> 63 else h

    r = random.Random(3)
    texts = ["", " ", "a", "a  b", " a b ", "a b c", "a b c\x1cd", "\ud800 x y z", "été ü 中文 x y", *(r.choice(["  ", " ", "\n"]).join(r.choices(["ab", "c", "é", "dd"], k=r.randint(0, 40))) for _ in range(60))]
    assert dedup.simhashes(texts * 2).tolist() == [plain(t) for t in texts] * 2


def test_a_text_is_hashed_once_in_a_batch(monkeypatch):
    """copies cost nothing, and a shingle costs one digest of bytes."""
    kept, n = dedup.md5, []
    monkeypatch.setattr(dedup, "md5", lambda x: (n.append(x), kept(x))[1])
    dedup.simhashes(["a b c d e"] * 50)
    assert n == [b"a b c", b"b c d", b"c d e"]


@pytest.mark.parametrize("n", [1000, 150_000, 236_000, 1_400_000, 30_000_000])
def test_blocks_where_no_key_rules_anything_out(n):
    """At 16 of 64 bits cells would gather half of all pairs."""
    assert not plan_for(n, 16).masks


def test_blocks_are_compared_in_tiles(spark):
    r = np.random.default_rng(3)
    base = r.integers(-(1 << 63), 1 << 63, 9000)
    h = np.unique(np.concatenate([base, base[:300] ^ r.integers(0, 1 << 16, 300)]))
    want = {tuple(sorted((int(h[i]), int(h[j])))) for lo in range(0, len(h), 64) for i, j in np.argwhere(np.bitwise_count((h[lo : lo + 64, None] ^ h[None, :]).view("uint64")) <= 16) + [lo, 0] if i < j}
    pairs = near_pairs(spark.createDataFrame([(int(x),) for x in h], "simhash long"), 16)
    assert pairs.rdd.getNumPartitions() == 3 * 4  # of three blocks, whatever the session's number
    got = [(x.a, x.b) for x in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 300
    i, j = (np.concatenate(x) for x in zip(*_close(h[:5000].view("uint64"), h[4000:].view("uint64"), 16)))
    assert {tuple(sorted((int(h[x]), int(h[4000 + y])))) for x, y in zip(i, j) if x != 4000 + y} <= want
