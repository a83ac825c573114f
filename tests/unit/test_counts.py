"""Words and tokens are counted by parts, with the results of the whole."""

import random

from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import tokens

PIECES = (" ", "  ", "\n", " \n", "\t", "\xa0", "　", "\x1c", "\x85", "a", "Bc", "é", "1", "23", "'s", "'ll", "!", "...", "<|endoftext|>", "日本", "​", "\r\n")


def odd(n):
    r = random.Random(7)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", " ", "a" * 1000 + " \t" * 500 + "b "]


def test_words_are_those_of_split(spark):
    rows = spark.createDataFrame([(x,) for x in [*odd(300), None]], "t string")
    plan = rows.select(T.word_count(F.col("t")).alias("n"))._jdf.queryExecution().toString()
    assert "regexp_count" not in plan  # a negated class per character
    for r in rows.select("t", T.word_count(F.col("t")).alias("n"), T.trimmed(F.col("t")).alias("u"), T.normalised(F.col("t")).alias("v")).collect():
        assert r.n == len((r.t or "").split())
        assert (r.u, r.v) == (None, None) if r.t is None else (r.u, r.v) == (r.t.strip(), " ".join(r.t.lower().split()))


def test_tokens_of_parts_are_those_of_the_whole(monkeypatch):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts, asked = odd(2000), []
    want = [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "PARTS", 50)  # what is remembered is forgotten on the way

    def count(parts):
        asked.extend(parts)
        return [len(e) for e in tok.encode_batch_fast(parts, add_special_tokens=False)]

    run = tokens.by_parts(count)
    assert [n for lo in range(0, len(texts), 100) for n in run(texts[lo : lo + 100])] == want
    asked.clear()
    assert run(["one two one. two"] * 3) == [len(tok.encode("one two one. two").ids)] * 3 and len(asked) == len(set(asked))
