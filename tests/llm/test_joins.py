import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import embedding_join, knn, ngram_join
from corpusflow.llm.embedding_join import near_vectors
from corpusflow.llm.graph import components
from corpusflow.llm.knn import top_k
from corpusflow.llm.ngram_join import Rule, all_signatures, divide_skip, heap_merge, jaccard_components, shingle_set


def reach(n, links):
    low = list(range(n))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(80, 99)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reach(100, links)
    assert got == {i: want[i] for i in {x for e in links if e[0] != e[1] for x in e}}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_divide_skip(seed):
    r = np.random.default_rng(seed)
    lists = [np.unique(r.integers(0, 30, r.integers(0, 25))).tolist() for _ in range(12)]
    weights = r.integers(1, 4 if seed % 2 else 2, 12).tolist()
    need = int(r.integers(1, 12))
    times = Counter()
    for x, w in zip(lists, weights):
        times.update({i: w for i in x})
    want = {i: c for i, c in times.items() if c >= need}
    assert dict(heap_merge(lists, weights, need)) == want
    found, n = divide_skip(lists, need, weights)
    assert dict(zip(found, n)) == want and found == sorted(found)


@pytest.mark.parametrize("num,den", [(80, 100), (90, 100), (50, 100), (100, 100)])
def test_linked_sets_share_a_signature(num, den):
    rule, r = Rule(num, den), random.Random(7)
    for _ in range(600):
        base = {r.getrandbits(64) for _ in range(r.choice([1, 2, 3, 5, 9, 20, 40, 90, 250]))}
        other = {x for x in base if r.random() > 0.12} | {r.getrandbits(64) for _ in range(r.randrange(0, 1 + len(base) // 8))}
        if not other:
            continue
        a, b = (np.sort(np.array(list(x), np.uint64)) for x in (base, other))
        if rule.linked(len(base & other), len(a), len(b)):
            for share in (0, 0.1, 0.3, 0.45, 0.6, 1):
                common = np.array(sorted(x for x in base | other if r.random() < share), np.uint64)
                assert len(np.intersect1d(all_signatures(a, common, rule), all_signatures(b, common, rule)))


def near_copies(seed, groups=12, each=14, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for g in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(3, n))]
        for k in range(each if g else 60):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocab)
            out.append(" ".join(t).upper() if k == 1 else " ".join(t))
    r.shuffle(out)
    return out


def plain(texts, k, num, den):
    sets = [set(shingle_set(t, k).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return sets, reach(len(sets), links)


@pytest.mark.parametrize("k,num,block", [(3, 90, 64), (5, 80, 5), (2, 80, 3)])
def test_jaccard_components(spark, monkeypatch, k, num, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BITS", {64: 1 << 26, 5: 1 << 10, 3: 64}[block])  # a full bitmap only lets more through
    monkeypatch.setattr(ngram_join, "FEW", {64: 8, 5: 3, 3: 2}[block])
    monkeypatch.setattr(ngram_join, "CELL", 20 if block == 3 else 1024)
    monkeypatch.setattr(ngram_join, "CELL_SIZE", 400 if block == 5 else 1 << 20)
    texts = near_copies(k)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, want = plain(texts, k, num, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, k, num, 100).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}
    assert len(set(want)) < len(texts)


def test_jaccard_of_rough_rows(rough, none):
    rows = jaccard_components(rough, 3, 90, 100).collect()
    assert len(rows) == rough.count()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [got[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert all(got[i].component_id == i for i in (1, 2, 3, 4, 5, 6, 7)) and got[8].component_id == got[9].component_id == 7
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard_components(none).count() == 0


def test_rows_of_one_id_join_their_texts(spark):
    a, b, c = (" ".join(random.Random(i).choices("pqrstuvwxyz", k=40)) for i in range(3))
    rows = [(5, a), (7, a), (7, b), (9, b), (8, c), (8, None), (4, ""), (None, a), (6, c), (6, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(docs, 3, 90, 100).collect()), key=repr)
    assert got == sorted([(5, 5), (7, 5), (7, 5), (9, 5), (8, 6), (8, 8), (4, 4), (None, None), (6, 6), (6, 6)], key=repr)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 50)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 8)), 12, axis=0) + 0.15 * rng.normal(size=(480, 8))
    x[7] = x[9] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, []), (None, [1.0] * 8), (1004, [1.0, 2.0]), (1005, [1.0, None] + [0.0] * 6)]
    df = spark.createDataFrame([(a, b, "l", "r") for a, b in rows], "vec_id long, embedding array<double>, left string, rep string")
    rows = near_vectors(df, 0.9, rows_per_cell=60).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    u = x / np.sqrt((x * x).sum(1))[:, None]
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    low = reach(480, [(i, j) for i, j in zip(*np.nonzero(s)) if i > j])
    assert all(got[i] == (int(s[i].sum()), low[i], low[i] == i) for i in range(480))
    assert all(got[i] == (0, i, True) for i in range(1000, 1006)) and got[None] == (0, None, False)
    assert near_vectors(df.limit(0)).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 50)
    rng = np.random.default_rng(2)
    x = np.floor(20 * (np.repeat(rng.normal(size=(30, 6)), 12, axis=0) + 0.2 * rng.normal(size=(360, 6))))
    x[50:90] = x[50]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("inf")] * 6), (None, [1.0] * 6)], "vec_id long, x array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 7 = 0"), 5, rows_per_group=60).collect())
    want = []
    for i in range(0, 360, 7):
        s = x @ x[i]
        best = [j for j in np.lexsort((np.arange(360), -s)) if j != i][:5]
        want += [(i, r + 1, int(j), int(s[j])) for r, j in enumerate(best)]
    assert got == sorted(want)
    few = df.where("vec_id < 3")
    assert top_k(few, few, 5).groupBy("query_id").agg(F.count("*").alias("n")).where("n = 2").count() == 3
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_vectors_of_one_id_and_of_other_lengths(spark):
    rows = [(3, [1.0, 0.0]), (3, [0.0, 1.0]), (5, [0.0, 2.0]), (7, [1.0, 0.01]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.001]), (11, [-1.0, -1.0])]
    got = sorted(tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect())
    # both rows of 3 are one node: 5 and 7 meet there
    assert [(i, c) for i, _, c, _ in got] == [(3, 3), (3, 3), (5, 3), (7, 3), (8, 8), (9, 8), (11, 11)]
    assert sorted(n for i, n, *_ in got if i == 3) == [1, 1] and [kept for i, _, _, kept in got] == [True, True, False, False, True, False, True]


def test_top_k_of_repeated_ids_and_other_lengths(spark):
    rows = [(1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (4, [5.0, 5.0]), (4, [1.0, 0.0]), (6, [1.0, 1.0, 1.0]), (7, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, x array<double>")
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id in (2, 6)"), 2).collect())
    # candidates are rows: (2, rank, vec, score)
    assert got == [(2, 1, 4, 10), (2, 2, 1, 3), (6, 1, 7, 2)]


def test_tasks_let_go_of_their_tables(spark, monkeypatch):
    class Table:
        columns = ["doc_id", "text"]

        def select(self, *_):
            return self

        def withColumn(self, *_):
            return self

        def mapInArrow(self, function, _):
            return function

    monkeypatch.setattr(ngram_join, "read_table", lambda uri: {"c": pa.table({"h": [1, 2]}), "b": pa.table({"w": pa.array([0], pa.int32()), "b": [-1]})}[uri])
    words = " ".join(map(str, range(40_000)))  # more than a generation of hashed words
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [words, "a b c"], "_h": pa.array([3, 70], pa.int64())})
    for task in (ngram_join._features(Table(), 3, Rule(9, 10), "c"), ngram_join._maybe(Table(), "doc_id", "b", lambda b: [b], "")):
        rows = [b.column("doc_id").to_pylist() for b in task(iter([batch]))]
        assert rows in ([[1, 2]], [[1]])
        assert not ngram_join._WORDS and not ngram_join._WORDS.old
        assert ngram_join._common.cache_info().currsize == ngram_join._bitmap.cache_info().currsize == 0


def test_repeated_signatures_are_found_by_their_hashes(spark, monkeypatch):
    """All that two rows have, next to nothing else, and few bytes to deal."""
    monkeypatch.setattr(ngram_join, "PART", 5000)
    r = np.random.default_rng(5)
    shared = r.integers(-(1 << 63), 1 << 63, 300)
    rows = [(i, [*r.integers(-(1 << 63), 1 << 63, 200).tolist(), *map(int, r.choice(shared, 3, replace=False))]) for i in range(400)] + [(900, []), (901, [-1, 0]), (902, [-1])]
    feats = spark.createDataFrame(rows, "key long, sigs array<long>").repartition(5)
    times = Counter(s for _, x in rows for s in x)
    want = {(k, s) for k, x in rows for s in x if times[s] > 1}
    got = {tuple(x) for x in ngram_join._repeated(feats).collect()}
    assert want <= got and len(got) <= len(want) + 30
    h = np.sort(r.integers(0, 1 << 40, 100_000).astype("uint64"))
    raw = ngram_join._packed(h)
    assert (ngram_join._unpacked(raw) == h).all() and len(pa.compress(raw, "lz4_raw", asbytes=True)) < 4 * len(h)
    assert len(ngram_join._unpacked(ngram_join._packed(h[:0]))) == 0
    assert not ngram_join._repeated(feats.limit(0)).count()
