import random
import re
from collections import Counter, defaultdict

import pytest

from corpusflow.llm.phrases import _CLEAN, _packed, _unpacked, collocations, slices


def plain(rows, least, longest, best):
    """rows: (text, lang)."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in chosen.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in chosen.items()):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(rows)[:best]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, rows=80, words=60):
    """Few words, so that phrases repeat, overlap themselves and contain each other."""
    r = random.Random(seed)
    names = ["a", "b", "b", "c", "d", "É", "é", "B", "x\x0by", "e-f", "日本", "\x1cz", "new york", "New York City", "a a a"]
    out = []
    for _ in range(rows):
        t = "".join(r.choice(names) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ; ", "\r\n", ""]) for _ in range(r.randint(0, words)))
        out.append((t, r.choice(["en", "en", "en", "de", None, "und", ""])))
    return out + [(None, "en"), ("", None), (" \t\n..", "fr"), ("only.once", "fr")]


def asked(spark, rows, **options):
    docs = spark.createDataFrame([(t, g, 1, "c", 2) for t, g in rows], "text string, lang string, rank long, phrase string, n long").repartition(3)
    got = collocations(docs, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("least,best,block,part", [(5, 2000, 1 << 21, 1 << 21), (3, 10, 40, 17), (1, 50, 3, 1 << 20)])
def test_collocations(spark, least, best, block, part):
    """Against plain counting, in one block a language and in blocks that end
    within texts and pieces."""
    rows = texts(least)
    if block == 3:
        rows = rows[:20]
    want = plain(rows, least, 4, best)
    assert len(want) > 20 and asked(spark, rows, least=least, best=best, block_words=block, part_entries=part) == want


def test_a_long_text_is_cut(spark, monkeypatch):
    """One text of many blocks without a break in it, the slices short."""
    r = random.Random(9)
    long_ = " ".join(r.choice("ab cd ef gh".split()) for _ in range(3000))
    rows = [(long_, "en"), (long_.replace(" ", "."), "en"), ("w" * 5000 + " " + long_, "de")]
    assert asked(spark, rows, least=30, block_words=500) == plain(rows, 30, 4, 2000)


@pytest.mark.parametrize("size", [1, 7, 50])
def test_slices(size):
    for t, _ in texts(4):
        data = (t or "").encode().translate(_CLEAN)
        parts = list(slices(data, size))
        assert b"".join(parts) == data
        assert all(p[-1:] in (b"\n", b" ") for p in parts[:-1])


def test_nothing_and_longer_phrases(spark):
    assert asked(spark, [], least=2) == [] == asked(spark, [("a b c", "en")], least=2)
    rows = texts(1)
    assert asked(spark, rows, least=4, longest=2) == plain(rows, 4, 2, 2000)
    assert asked(spark, rows, least=4, longest=6) == plain(rows, 4, 6, 2000)


def test_parts_come_in_any_order():
    """A block's lists are numbered alike however what it is told is ordered."""
    import numpy as np
    import pyarrow as pa

    from corpusflow.llm.phrases import _lists

    r = random.Random(5)
    ids = np.array([r.choice([0, 1, 2, 3, 4, 5]) for _ in range(400)], "int32")
    state = {"ids": _packed(ids), "n": len(ids), "context": 0}
    base = _lists(state, told(pa, np, [(1, [0, 1, 2, 3, 4], [50, 40, 30, 20, 10])]), 1).extended()[2]
    rows = [(1, [4, 0], [10, 50]), (1, [2, 1], [30, 40]), (1, [3], [20])]
    pairs = [(2, [i], [1000 + i]) for i in range(0, len(base), 2)]
    found = []
    for _ in range(5):
        r.shuffle(rows)
        r.shuffle(pairs)
        x = _lists(state, told(pa, np, rows + pairs), 2)
        found.append((x.at.tolist(), x.gids[x.code].tolist(), x.extended()[2].tolist()))
    assert found[0][0] and all(f == found[0] for f in found)


def told(pa, np, rows):
    return pa.table({"length": pa.array([k for k, _, _ in rows], pa.int32()), "m": pa.array([len(x) for _, x, _ in rows], pa.int32()), "local": [_packed(np.array(x, "int32")) for _, x, _ in rows], "gid": [_packed(np.array(x, "int64")) for _, _, x in rows]})


def test_packed():
    import numpy as np

    for kind in ("int32", "int64"):
        for n in (0, 1, 1000):
            x = np.arange(n, dtype=kind) * 977 - 5
            assert (_unpacked(_packed(x), n, kind) == x).all()
