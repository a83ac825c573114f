import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import tokens
from corpusflow.llm.packing import best_plan, configurations, group_lengths, pack, pack_documents, plan
from corpusflow.llm.tokens import TokenFile, _finer, encode_texts, read_token_files, write_token_files
from corpusflow.llm.common import tokenizer_path


def direct(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


ODD = ["Don't stop, it's. (ok), a.,b 3.5, x²,y ½. İstanbul ΣΑΣ. J̌, Å, é. <|endoftext|>, a.\n\nb , . c\t.d\x1c.　, ", "", " ", ".,", ", .", "so,then. yes", "A" * 3000]


@pytest.mark.parametrize("text", ODD)
def test_memo_gives_the_librarys_ids(text):
    assert next(encode_texts([text])).tolist() == direct(text)


def test_other_vocabularies_are_encoded_whole():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    text = "two  blanks and\n lines"
    assert next(encode_texts([text], path)).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, rough):
    shards = write_token_files(rough, seq_len=64, batch=3)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, shards).collect())
    rows = [(r.doc_id, np.array([*direct(r.text), 1], "<u4")) for r in rough.collect()]
    assert len(got) == len(rows)
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    assert sum(n for *_, n, _ in got) == sum(len(x) for _, x in rows)
    known = {}
    at = sum(len(x) for i, x in rows if i is None)
    for i, x in rows:
        if i is not None and i != 10:
            known[i] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x) if i is not None else 0
    for has, i, *rest in got:
        if has and i != 10:
            assert tuple(rest) == known[i]
    flat = []
    for r in shards.orderBy("shard").collect():
        file = TokenFile(r.uri)
        rows_ = [file.get(i) for i in range(len(file))]
        assert all(not x.flags.owndata and not x.flags.writeable and len(x) == 64 for pair in rows_ for x in pair)
        ids, mask = (np.concatenate(x) for x in zip(*rows_))
        assert mask.sum() == r.n_tokens and (np.diff(mask.astype(int)) <= 0).all()
        flat.append(ids[mask > 0])
    flat = np.concatenate(flat)
    assert all(zlib.crc32(flat[start : start + n].astype("<u4").tobytes()) == crc for _, _, start, n, crc in got)


def test_sequences_are_views_of_the_mapped_file(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 200) for i in range(40)], "doc_id long, text string").coalesce(1)
    row = write_token_files(docs, seq_len=32, batch=4).collect()[0]
    file = TokenFile(row.uri)
    before = pa.total_allocated_bytes()
    ids, mask = file.get(len(file) // 2)
    whole = file._bytes(0, file.file.size())
    assert len(file) > 8 * file.batch and whole.address <= ids.ctypes.data < whole.address + whole.size
    assert whole.address <= mask.ctypes.data < whole.address + whole.size
    assert pa.total_allocated_bytes() - before < 10_000
    with pytest.raises(IndexError):
        file.get(len(file))


def test_a_hot_id_and_rows_without_id_have_several_files(spark):
    rows = [(None, f"none {i}") for i in range(40)] + [(5, "same text")] * 60 + [(i, f"other {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shards = write_token_files(docs, seq_len=8, file_bytes=1 << 62)
    assert max(r.n_docs for r in shards.collect()) <= 60
    shards = write_token_files(docs, seq_len=8, file_bytes=80)
    got = sorted(read_token_files(spark, shards).collect(), key=lambda r: r.start)
    assert max(r.n_docs for r in shards.collect()) <= 30
    ids = [r.doc_id for r in got]
    assert ids[:40] == [None] * 40 and ids[40:] == sorted(ids[40:]) and len(ids) == 120
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_finer_cuts():
    assert _finer(np.array([0, 10, 10, 20]), 2).tolist() == [0, 5, 10, 10, 10, 15, 20]


def test_token_files_of_nothing(spark, none):
    assert read_token_files(spark, write_token_files(none)).count() == 0


def lay_out(runs, n, hist, capacity):
    held = {}
    for length, first, count, seq, offset in runs.tolist():
        for k in range(count):
            held.setdefault(seq + k, []).append((offset, length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(held) == list(range(n))
    for length, count in hist.items():
        spans = sorted((f, f + c) for le, f, c, _, _ in runs.tolist() if le == length)
        assert spans[0][0] == 0 and spans[-1][1] == count and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("seed", range(40))
def test_plans_hold_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 50, 128])
    hist = {}
    for _ in range(r.randint(1, 400)):
        k = min(capacity, int(r.lognormvariate(2.5, 1)) + 1)
        hist[k] = hist.get(k, 0) + 1
    for made in (plan(hist, capacity), best_plan(hist, capacity)):
        lay_out(*made, hist, capacity)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    x = np.clip(rng.lognormal(6.2, 1, 20000).astype(int) + 1, 1, 2048)
    hist = dict(zip(*[v.tolist() for v in np.unique(x, return_counts=True)]))
    _, n = best_plan(hist, 2048)
    assert n <= 1.01 * -(-int(x.sum()) // 2048)


def test_configurations_match_the_known_optimum():
    # 60 of 6 and 60 of 4 in tens: pairs of both
    found = configurations(np.array([6, 4]), np.array([60.0, 60.0]), 10)
    assert abs(sum(x for _, x in found) - 60) < 1e-6
    assert [sum(n for _, n in g) for g in group_lengths(np.array([1, 2, 3]), np.array([3, 3, 3]), 3)] == [3, 3, 3]


def test_plan_of_nothing_and_of_bad_lengths():
    assert plan({}, 10)[1] == 0
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


def test_pack_documents(rough, none):
    rows = pack_documents(rough, capacity=64).collect()
    want = {}
    for r in rough.collect():
        x = np.array([*direct(r.text), 0], "<u4")
        for j, at in enumerate(range(0, len(x), 64)):
            want.setdefault((r.doc_id, j, at, len(x[at : at + 64]), zlib.crc32(x[at : at + 64].tobytes())), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in held.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 64
    assert len(held) <= 1.05 * -(-sum(r.length for r in rows) // 64) + 1
    assert pack_documents(none).count() == 0


def test_one_length_with_all_rows_is_spread(spark):
    rows = spark.range(500).selectExpr("id as doc_id", "0 as piece", "cast(7 as long) as length")
    got = pack(rows, 20, rows_per_salt=5).groupBy("sequence_id").count().collect()
    assert len(got) == 250 and all(r["count"] == 2 for r in got)


def test_memos_hold_a_bounded_number_of_parts():
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(x) for x in itertools.islice(itertools.product(letters, repeat=4), 300_000)]
    texts = [" ".join(words[lo : lo + 1000]) for lo in range(0, len(words), 1000)]
    tokens._forget()
    first = [ids.tobytes() for ids in encode_texts(texts[:3])]
    assert sum(len(ids) for ids in encode_texts(texts, memo=tokens.SMALL_MEMO)) > len(words)
    assert all(len(memo) + len(memo.old) <= 130_000 for memo in tokens._MEMOS)
    assert [ids.tobytes() for ids in encode_texts(texts[:3])] == first
    tokens._forget()
