import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusflow.llm.windows import Quantile, event_time, rolling_features


@pytest.mark.parametrize("seed", range(20))
def test_quantile_follows_its_rank(seed):
    """Values that come and go, few of them distinct, against a sorted list."""
    r = random.Random(seed)
    num, den = r.choice([(1, 2), (75, 100), (1, 100), (1, 1)])
    q, held = Quantile(num, den), []
    for _ in range(600):
        if held and r.random() < (0.45 if seed % 2 else 0.55):
            v = r.choice(held)
            n = r.randint(1, held.count(v))
            for _ in range(n):
                held.remove(v)
            q.remove(v, n)
        else:
            v, n = r.choice([r.randint(0, 5), r.randint(0, 10**12)]), r.randint(1, 3)
            held += [v] * n
            q.add(v, n)
        if r.random() < 0.7:
            held.sort()
            assert q.value() == (held[-(-num * len(held) // den) - 1] if held else None)
        assert q.low.total + q.high.total == len(held)
        for h in (q.low, q.high):
            assert h.dead == sum(c == 0 for c in h.counts.values()) and len(h.order) == len(h.counts)
            assert h.dead <= 65 or 2 * h.dead <= len(h.order) + 1  # tombstones do not pile up


def test_event_time(spark):
    ids = [0, 7, 123456, -5, -6000, 10**15, None]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(event_time(F.col("i")).alias("t")).collect()
    want = [None if i is None else 60 * ((i + zlib.crc32(str(i).encode()) % 4000) // 6) for i in ids]
    assert [r.t for r in got] == want
    huge = spark.range(1).select(event_time(F.lit(2**63 - 1)).alias("t")).first().t
    assert huge is None


def plain(rows, windows, quantiles):
    """rows: (doc_id, source, lang, length)."""
    timed = [(r, None if r[0] is None else 60 * ((r[0] + zlib.crc32(str(r[0]).encode()) % 4000) // 6)) for r in rows]
    out = []
    for r, t in timed:
        for w in windows:
            seen = [x for x, u in timed if t is not None and u is not None and x[1] == r[1] and t - w <= u < t]
            sizes = sorted(x[3] for x in seen if x[3] is not None)
            q = [sizes[-(-num * len(sizes) // den) - 1] if sizes else None for num, den in quantiles]
            out.append((r[0], w, t, len(seen), sum(sizes), len({x[2] for x in seen} - {None}), *q))
    return sorted(out, key=repr)


def asked(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rolling_features(spark, rough, none):
    """Nulls, repeats, a hot source, a hot id, ties: as counted row by row."""
    r = random.Random(3)
    rows = [(r.choice([i, i, 5, None]), r.choice(["a", "a", "b", None]), r.choice(["en", "de", None]), r.choice([None, "", "ä" * r.randint(1, 4), "x" * r.randint(0, 900)])) for i in range(400)]
    docs = spark.createDataFrame([(i, s, g, t, 1, "w") for i, s, g, t in rows], "doc_id long, source string, lang string, text string, n_events long, window_s string")
    sized = [(i, s, g, None if t is None else len(t)) for i, s, g, t in rows]
    want = plain(sized, (3600, 21600), ((1, 2), (75, 100)))
    assert asked(rolling_features(docs)) == want
    assert asked(rolling_features(docs.repartition(7), cell_s=21600 * 3)) == want  # however time is cut
    assert asked(rolling_features(docs, cell_s=600)) == want
    other = rolling_features(docs, windows=(60, 500, 10**6), quantiles=(("least", 1, 10**6),))
    assert other.columns == ["doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "least"]
    assert asked(other) == plain(sized, (60, 500, 10**6), ((1, 10**6),))
    assert rolling_features(rough).count() == 2 * rough.count()
    assert rolling_features(none).count() == 0
    with pytest.raises(ValueError, match="n_events"):
        rolling_features(docs, keep=("doc_id", "n_events"))


def test_own_times(spark):
    docs = spark.createDataFrame([(i, "s", "en", "x" * i, 10 * i) for i in range(50)], "doc_id long, source string, lang string, text string, at long")
    got = rolling_features(docs, windows=(30,), time=F.col("at")).where("doc_id = 40").first()
    assert (got.n_events, got.sum_chars, got.median_chars, got.high_chars) == (3, 37 + 38 + 39, 38, 39)
