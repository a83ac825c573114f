import hashlib
import random
import re

import pytest

from corpusflow.llm import leaks
from corpusflow.llm.leaks import decontaminate, proximity_matches, tokenised

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, n):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            v = words(t)
            k = min(n, len(v))
            for j in range(len(v) - k + 1) if k else ():
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == v[j : j + k]:
                        hit.update(range(i, i + k))
                        ids.add(item_id)
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def some(seed):
    r = random.Random(seed)
    names = ["the", "The", "of", "Straße", "ÄÖ", "äö", "日本語", "x1", "42", "rare", "alpha", "beta", "gamma"]
    part = lambda lo, hi: "".join(r.choice(names) + r.choice([" ", " ", ", ", "\n", "--", "_", "\x00"]) for _ in range(r.randint(lo, hi)))
    items = [(i if i % 5 else None, part(1, 30)) for i in range(25)] + [(3, part(3, 12)), (90, None), (91, "?!"), (92, "the the the the the the the"), (93, "nowhere to be seen"), (7, part(12, 12))]
    items += [(200, items[1][1]), (1, items[1][1])]  # one text, several ids; an id twice
    docs = []
    for i in range(60):
        t = part(0, 40)
        if i % 3 == 0:
            t += r.choice(items)[1] or ""
            t += part(0, 15)
        if i % 7 == 0:
            v = words(r.choice(items)[1])
            t = " ".join(v[2:9]).upper() + " " + t
        docs.append((r.choice([i, i, 1, None]), t))
    return docs + [(500, None), (501, ""), (502, "!!"), (503, "the " * 50), docs[0]], items


DOCS, ITEMS = "doc_id long, text string, n_hit long, word string, at int, start long", "item_id long, text string, pid long"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "w", 2, 3) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, 9) for i in items], ITEMS)


def asked(spark, docs, items, **options):
    return sorted((tuple(r) for r in decontaminate(*frames(spark, docs, items), **options).collect()), key=repr)


@pytest.mark.parametrize("seed,n,cut,small", [(1, 10, 1 << 16, True), (2, 4, 30, True), (3, 5, 7, False), (4, 1, 50, True)])
def test_decontaminate(spark, monkeypatch, seed, n, cut, small):
    """Against all places of all windows; texts in one row and in rows of few
    characters; tables sent to every task, and joined by key."""
    if not small:
        monkeypatch.setattr(leaks, "SMALL_ROWS", -1)
    docs, items = some(seed)
    assert asked(spark, docs, items, n=n, slice_chars=cut) == plain(docs, items, n)


def test_nothing(spark):
    docs, items = some(5)
    assert asked(spark, [], items) == []
    assert asked(spark, docs, []) == plain(docs, [], 10)
    with pytest.raises(ValueError, match="n_hit"):
        decontaminate(*frames(spark, docs, items), keep=("doc_id", "n_hit"))
    kept = decontaminate(*frames(spark, docs, items), keep=("doc_id", "word"))
    assert kept.columns[:2] == ["doc_id", "word"] and kept.count() == len(docs)


@pytest.mark.parametrize("cut", [1 << 16, 64, 5])
def test_rows_of_a_text(spark, cut):
    """Rows have all words in order, and the words that follow."""
    docs, _ = some(6)
    docs = [(i, t) for i, (_, t) in enumerate(docs)] + [(999, "w" * 300 + " " * 300 + "two 3 ")]
    rows = tokenised(frames(spark, docs, [])[0], 3, slice_chars=cut).selectExpr("keep.doc_id", "start", "n", "words", "n_words").orderBy("doc_id", "start").collect()
    for i, t in docs:
        mine = [r for r in rows if r.doc_id == i]
        full = words(t)
        assert sum(r.n for r in mine) == len(full) and [r.n_words for r in mine if r.n_words is not None] == [len(full)]
        for r in mine:
            assert r.words == full[r.start : r.start + r.n + 3] or (not full and r.words == [])


@pytest.mark.parametrize("cut,slop", [(1 << 16, 4), (40, 6), (9, 2)])
def test_proximity(spark, cut, slop, monkeypatch):
    monkeypatch.setattr(leaks, "tokenised", lambda d, tail, keep: tokenised(d, tail, keep, cut))
    docs, items = some(7)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    items = [(i, t) for i, (_, t) in enumerate(items)] + [(300, "rare 42"), (301, "beta"), (302, "alpha gamma beta")]
    every = [w for _, t in docs for w in words(t)]
    want = []
    for d, t in docs:
        w = words(t)
        for i, s in items:
            need = set(words(s))
            if not need or any(x not in every for x in need):
                continue
            lead = min(need, key=lambda x: (every.count(x), x.encode()))
            for at, x in enumerate(w):
                lo, hi = max(0, at - slop), min(len(w), at + slop + 1)
                if x == lead and need <= set(w[lo:hi]):
                    hits = [j for j in range(lo, hi) if w[j] in need]
                    want.append((d, str(i), at, hits[0], hits[-1]))
    got = proximity_matches(*frames(spark, docs, items), slop=slop).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
