import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm.mixing import mix, sainte_lague, targets
from corpusflow.llm.sharding import shard, write_shards


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1], 300, 3.0) == pytest.approx([187.5, 75, 37.5])
    got = targets([10, 1000, 1000], [5, 2, 1], 2010, 3.0)
    assert got[0] == 30 and got[1:] == pytest.approx([1320, 660])
    assert targets([0, 5], [5, 2], 5, 3.0) == [0, 5]
    assert targets([], [], 0, 3.0) == []


def brute(claims, seats, caps):
    got = [0] * len(claims)
    for _ in range(seats):
        open_ = [i for i in range(len(claims)) if got[i] < caps[i] and claims[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (claims[i] / (2 * got[i] + 1), -i))] += 1
    return got


@pytest.mark.parametrize("seed", range(60))
def test_sainte_lague_is_highest_quotients(seed):
    r = random.Random(seed)
    claims = [r.choice([0, 1, 3, 10, 50, 333.3]) * r.random() for _ in range(r.randint(1, 9))]
    caps = [r.randint(0, 30) for _ in claims]
    seats = r.randint(0, 90)
    assert sainte_lague(np.array(claims), seats, np.array(caps)).tolist() == brute(claims, seats, caps)


def test_mix(rough, none):
    rows = mix(rough, rows_per_shard=7, blocks_per_target=50).collect()
    assert len(rows) == rough.count()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
        assert 0 <= r.first_taken <= 3
    words = {s: sum(x.size for x in v) for s, v in by.items()}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = targets([words[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], sum(words.values()), 3.0)
    for s, g in zip(order, goal, strict=True):
        assert all(x.source_size == words[s] and x.target == pytest.approx(g) for x in by[s])
        assert sum(x.taken for x in by[s]) == pytest.approx(g, rel=0.06)
    again = mix(rough.repartition(3), rows_per_shard=7, blocks_per_target=50).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert mix(none).count() == 0


def test_a_hot_id_is_spread(spark):
    """A third of the rows with one id, a third with none: no shard has much
    more than another."""
    rows = [((i, 7, None)[i % 3], f"text {i} " * (1 + i % 5), "a") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, rows_per_shard=100)
    assert sum(r.taken for r in got.collect()) == pytest.approx(sum(len(t.split()) for _, t, _ in rows), rel=0.01)
    shards = docs.select(F.pmod(F.xxhash64(F.lit(30), "doc_id", F.xxhash64("text")), F.lit(60)).alias("s")).groupBy("s").count().toPandas()["count"]
    assert len(shards) == 60 and shards.max() <= 2 * shards.median()


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(i, f"w {i}", "a", i, "k") for i in range(30)], "doc_id long, text string, source string, start long, shard string")
    got = mix(docs, keep=("start", "shard"))
    assert got.columns[-2:] == ["start", "shard"] and sorted(r.start for r in got.collect()) == list(range(30))
    with pytest.raises(ValueError, match="taken"):
        mix(docs.withColumn("taken", F.lit(1)), keep=("taken",))


def test_capped_source_reaches_its_target(spark):
    rows = [(i, "w " * 7, "a") for i in range(60)] + [(100 + i, "w " * 50, "b") for i in range(60)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows_per_shard=2, blocks_per_target=100).where("source = 'a'").collect()
    assert got[0].target == 3 * 420 and sum(r.taken for r in got) == pytest.approx(3 * 420, abs=12)


def test_shards_fit_and_only_large_ones_split(rough):
    rows = shard(rough, 3000).collect()
    assert len(rows) == rough.count()
    size = defaultdict(int)
    count = Counter(r.shard_id for r in rows)
    for r in rows:
        size[r.shard_id] += r.bytes
    for r in rows:
        assert r.shard_bytes == size[r.shard_id] and r.shard_rows == count[r.shard_id]
        assert r.shard_bytes <= 3000 or (r.oversize and r.shard_rows == 1)
        assert r.shard_id.bit_length() - 1 == r.local_depth
    ids = set(size)
    for s in ids:  # a shard's parent holds more than the limit
        if s > 1:
            parent = s >> 1
            below = sum(b for i, b in size.items() if i.bit_length() >= parent.bit_length() and i >> (i.bit_length() - parent.bit_length()) == parent)
            assert below > 3000


def test_one_key_with_all_rows_is_split(spark):
    same = spark.range(400).selectExpr("cast(5 as long) as doc_id", "repeat('x', 100) as text")
    rows = shard(same, 2500).collect()
    assert len(rows) == 400 and all(r.shard_bytes <= 2500 for r in rows)


def test_shards_of_nothing_and_written(spark, none, rough, tmp_path):
    assert shard(none, 100).count() == 0
    with pytest.raises(ValueError):
        shard(none, 0)
    some = rough.where("doc_id >= 100").select("doc_id", "text")
    write_shards(some, str(tmp_path / "s"), 4000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == some.count()


def test_rows_of_one_key_are_written_apart(spark, tmp_path):
    same = spark.range(400).selectExpr("cast(5 as long) as doc_id", "repeat('x', 100) as text")
    sizes = {r.shard_id: r.shard_rows for r in write_shards(same, str(tmp_path / "s"), 2500).collect()}
    written = spark.read.parquet(str(tmp_path / "s")).groupBy("shard_id").count().collect()
    assert {r.shard_id: r["count"] for r in written} == sizes and max(sizes.values()) <= 25


def test_written_shards_hold_null_and_repeated_keys(spark, tmp_path):
    rows = [(None, "x" * 90)] * 30 + [(7, "y" * 90)] * 30 + [(8, None), (9, "")] * 3 + [(i, "z" * 50) for i in range(100, 160)] + [(10, "long " * 900)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, shard string, bytes int").repartition(3)
    sizes = {r.shard_id: (r.shard_bytes, r.shard_rows) for r in write_shards(docs, str(tmp_path / "s"), 1000).collect()}
    written = spark.read.parquet(str(tmp_path / "s"))
    got = {r.shard_id: (r.b or 0, r.n) for r in written.groupBy("shard_id").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()}
    assert got == sizes and all(b <= 1000 or n == 1 for b, n in got.values())
    assert Counter((r.doc_id, r.text) for r in written.collect()) == Counter(rows)


def plain_mix(rows, weights, most, per_shard, per_target, seed):
    """The mix word by word.  rows: (id, source, size, shard of a hash, place)."""
    sources = sorted({r[1] for r in rows}, key=lambda x: (x is None, x or ""))
    words = {x: sum(r[2] for r in rows if r[1] == x) for x in sources}
    goal = dict(zip(sources, targets([words[x] for x in sources], [weights[i % len(weights)] for i in range(len(sources))], sum(words.values()), most)))
    block = max(1, int(min(g for g in goal.values() if g > 0) // per_target))
    quota = dict(zip(sources, brute([goal[x] for x in sources], round(sum(goal.values()) / block), [int(most * words[x]) // block for x in sources])))
    out = {}
    for x in sources:
        mine = [r for r in rows if r[1] == x]
        shards = max(1, -(-len(mine) // per_shard))
        dealt = defaultdict(list)
        for r in mine:
            dealt[r[3] % shards].append(r)
        names = sorted(dealt)
        room = [int(most * sum(r[2] for r in dealt[n])) for n in names]
        seats = brute([sum(r[2] for r in dealt[n]) for n in names], min(quota[x], sum(m // block for m in room)), [m // block for m in room])
        take = [block * n for n in seats]
        left = quota[x] * block - sum(take)
        for i in range(len(names)):
            more = min(max(0, left), room[i] - take[i])
            take[i], left = take[i] + more, left - more
        for n, t in zip(names, take):
            order = sorted(dealt[n], key=lambda r: r[4])
            line = [r[0] for r in order for _ in range(r[2])]
            times = Counter()
            if line:
                start = (seed(x, n) % max(1, len(line) // block)) * block
                times.update(line[(start + i) % len(line)] for i in range(t % len(line)))
                times.update({i: c * (t // len(line)) for i, c in Counter(line).items()})
            for r in order:
                out[r[0]] = times[r[0]]
    return out


def test_words_taken_are_the_mix_word_by_word(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.choice([0, 1, 3, 9, 30, r.randint(0, 60)]), r.choice(["a", "b", "c", None, "d"])) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x.taken for x in mix(docs, rows_per_shard=9, blocks_per_target=40).collect()}
    hashed = {x.doc_id: (x.s, (x.o, x.doc_id)) for x in docs.select("doc_id", F.xxhash64(F.lit(30), "doc_id", F.xxhash64("text")).alias("s"), F.xxhash64(F.lit(29), "doc_id", F.xxhash64("text")).alias("o")).collect()}

    def seed(source, shard):
        at = spark.createDataFrame([(source, shard)], "source string, shard long")
        return at.select(F.xxhash64(F.lit(31), "source", "shard")).first()[0]

    plain = plain_mix([(i, s, len(t.split()), *hashed[i]) for i, t, s in rows], (5, 2, 1), 3.0, 9, 40, seed)
    assert got == plain


def test_sources_come_without_python_workers(spark):
    docs = spark.sql("select id as doc_id, concat('s', id % 3) as source, 'a b c' as text from range(30)")
    mixed = mix(docs)
    assert "ExistingRDD" not in mixed._jdf.queryExecution().toString()
    assert mixed.count() == 30
