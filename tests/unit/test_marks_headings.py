"""Marks behind link texts, and headings above pieces, against plain loops."""

import random
import time

import pytest

from corpusflow.operators import links
from corpusflow.operators.links import first_places, marked
from corpusflow.operators.split import crumbs, standing


def one_by_one(text, marks):
    done = set()
    for w, chunk in marks:
        w = (w or "").strip()
        if w and chunk is not None and w not in done and w in text:
            text = text.replace(w, f"{w} [-> {chunk}]", 1)
            done.add(w)
    return text


@pytest.mark.parametrize("seed", range(300))
def test_marked_is_one_after_the_other(seed, monkeypatch):
    """Texts that overlap, contain each other, and look like marks."""
    if seed % 3 == 0:
        monkeypatch.setattr(links, "ahocorasick", None)
    r = random.Random(seed)
    letters = r.choice(["ab", "ab ", "ab [", "ab ]-> c1", "abcdefgh "])
    text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
    some = [text[i : i + r.randint(1, 6)] for i in (r.randrange(len(text) or 1) for _ in range(12))]
    some += [r.choice(["a", "ab", "c1", "-> c", "c1]", "] a", "b [", "b [-> c1]", "[->", "", None, " a "]) for _ in range(6)]
    r.shuffle(some)
    marks = [(w, r.choice(["c1", "c2", "ab", None])) for w in some]
    assert marked(text, marks) == one_by_one(text, marks)


def test_ten_thousand_marks():
    r = random.Random(1)
    names = [f"link {i} of {r.randrange(10**6)}" for i in range(10_000)]
    text = " ".join(r.choice(names) + " and words between" for _ in range(60_000))
    marks = [(n, f"docs_chunk_{i % 50:02d}") for i, n in enumerate(names)]
    began = time.perf_counter()
    got = marked(text, marks)
    assert time.perf_counter() - began < 20
    there = first_places(text, names)
    assert got.count(" [-> docs_chunk_") == len(there) > 9000
    for n in r.sample(sorted(there), 50):
        assert got.index(f"{n} [-> ") == got.index(n)


def plain(headings, offset):
    active = {}
    for h in headings:
        if h["char_offset"] > offset:
            break
        active = {k: v for k, v in active.items() if k <= h["level"]} | {h["level"]: h}
    return [active[k]["text"] for k in sorted(active)]


@pytest.mark.parametrize("seed", range(50))
def test_standing(seed):
    r = random.Random(seed)
    headings = sorted(({"level": r.randint(1, 6), "text": str(i), "char_offset": r.randint(0, 60)} for i in range(r.randint(1, 25))), key=lambda h: h["char_offset"])
    offsets = sorted(r.randint(0, 70) for _ in range(12))
    assert list(standing(headings, offsets)) == [plain(headings, x) for x in offsets]
    want = [plain(headings, x) for x in offsets]
    assert crumbs(headings, offsets)[0] == (want[0] or plain(headings, headings[0]["char_offset"]))
    assert crumbs(headings, offsets)[1:] == want[1:] and crumbs(None, offsets) == crumbs([], offsets) == [[] for _ in offsets]


def test_many_headings_stay_linear():
    def took(n):
        headings = [{"level": 1 + i % 6, "text": "h", "char_offset": 10 * i} for i in range(n)]
        began = time.perf_counter()
        assert len(list(standing(headings, list(range(0, 10 * n, 5))))) == 2 * n
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < 5
