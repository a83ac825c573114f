"""Token counts with a local vocabulary."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Short names of encodings.
ALIASES = {"cl100k": "cl100k_base", "o200k": "o200k_base", "p50k": "p50k_base"}
#: Where byte_bpe_50k always parts a text: before a blank that no white space follows, and between a letter and a mark or line end.
_PART = re.compile(r"(?= \S)|(?<=[^\W\d_])(?=[.,;:!?\n])")
#: Parts that a worker remembers, and their longest.
PARTS, PART_CHARS = 500_000, 32


def by_parts(count: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    """The same numbers of tokens, a part that was met being remembered."""
    known: dict[str, int] = {}

    def run(texts: list[str]) -> list[int]:
        if len(known) > PARTS:
            known.clear()
        parts = [_PART.split(t) for t in texts]
        new = [p for p in set(chain.from_iterable(parts)) if p not in known]
        n = dict(zip(new, count(new), strict=True))
        known.update(n)
        out = [sum(map(known.__getitem__, p)) for p in parts]
        for p in new:
            if len(p) > PART_CHARS:
                del known[p]
        return out

    return run


@lru_cache(maxsize=4)
def encoder(name: str):
    """text -> number of tokens.  Vocabularies of the installed
    public_tokenizers package by their base name; other names are asked of
    tiktoken, which may need a network.  Special tokens' strings are text."""
    name = ALIASES.get(name, name)
    try:
        import public_tokenizers as local
    except ImportError:
        local = None
    if local is not None and name in ("byte_bpe_50k", "word_bpe_49k"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(local.path(f"{name}.json"))
        tok.encode_special_tokens = True
        count = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        return by_parts(count) if name == "byte_bpe_50k" else count
    if local is not None and name == "piece_bpe_32k":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=local.path("piece_bpe_32k.model"))
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    import tiktoken

    if name not in tiktoken.list_encoding_names():
        raise ValueError(f"encoding {name!r} is not known; try byte_bpe_50k, word_bpe_49k, piece_bpe_32k or {', '.join(ALIASES)}")
    enc = tiktoken.get_encoding(name)
    return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]


def token_counts(texts: DataFrame, encoding: str = "byte_bpe_50k", text: str = "text") -> DataFrame:
    """All columns but the text, with ``words`` and ``tokens``; no words, no tokens."""
    keep = [c for c in texts.columns if c != text]
    types = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(encoding)
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                raw = [t or "" for t in part.column(text).to_pylist()]
                n_words = [len(t.split()) for t in raw]
                tokens = [n if w else 0 for n, w in zip(count(raw), n_words, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(n_words, pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, "words", "tokens"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "words long", "tokens long"])
    return texts.select(*keep, text).mapInArrow(run, schema)


def summary(counts: DataFrame) -> DataFrame:
    """One row: total, floored mean, least and most tokens."""
    t = counts.agg(F.sum("tokens").alias("total"), F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most"))
    return t.select("total", F.expr("total div n").alias("average"), "least", "most")


__all__ = ["encoder", "summary", "token_counts"]
