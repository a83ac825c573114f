"""Language identification with error-correcting output codes.

Each learned language has a codeword of +1 and -1; one binary classifier per
bit, logistic regression on hashed byte n-grams, predicts that bit.  Decoding
adds up, over the bits, the logistic loss of each codeword's bit, weighted by
how well the bit's classifier does on rows that it was not fitted on, and takes the codeword of
least loss.  A small lead over the runner-up flags the text as ambiguous.

The classifier is fitted on a bounded sample of labelled rows (``sample_rows``
in all, the same number per language); every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import grouped, turn_to

#: Buckets that byte n-grams are hashed to.
BUCKETS = 4096
_TO_BLANK = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Texts, and bytes of a text, that are counted at once.
_GROUP, PIECE = 64, 1 << 18


def features(texts: list[str]) -> np.ndarray:
    """Rows of square roots of relative 2- and 3-gram frequencies.  Texts are
    counted in pieces of at most PIECE bytes, about as many at a time."""
    counts = np.zeros((len(texts), BUCKETS))
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, t in enumerate(texts):
        raw = np.frombuffer(b" " + t.lower().encode("utf-8", "replace").translate(_TO_BLANK) + b"  ", "uint8")
        for lo in range(0, max(1, len(raw) - 2), PIECE):
            held.append((i, raw[lo : lo + PIECE + 2]))  # a gram belongs to the piece that it begins in
            size += len(held[-1][1])
            if size >= PIECE:
                _count(held, counts)
                held, size = [], 0
    if held:
        _count(held, counts)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype("float32")


def _count(pieces: list[tuple[int, np.ndarray]], counts: np.ndarray) -> None:
    """Adds the pieces' grams to the counts of their texts."""
    first, last = pieces[0][0], pieces[-1][0]
    all_ = np.concatenate([x for _, x in pieces]).astype("uint32")
    size = np.array([len(x) for _, x in pieces])
    own = np.repeat(np.array([i - first for i, _ in pieces], "int64") * BUCKETS, size)
    a, b, c = all_[:-2], all_[1:-1], all_[2:]
    keep = (a != 32) | (b != 32)  # runs of blanks say nothing
    ends = np.cumsum(size)[:-1]
    keep[np.r_[ends - 1, ends - 2]] = False  # no gram spans two pieces
    three = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) >> np.uint32(20)).astype("int64")
    two = ((a * np.uint32(0x27D4EB2F) + b * np.uint32(0x165667B1)) >> np.uint32(20)).astype("int64")
    at, n = own[:-2], (last - first + 1) * BUCKETS
    both = np.bincount((at + three)[keep], minlength=n) + np.bincount((at + two)[keep], minlength=n)
    counts[first : last + 1] += both.reshape(-1, BUCKETS)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """(n, bits) of +-1: the exhaustive code up to six languages, else the
    best of seeded random codes by least distance of two rows."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        cols = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), size=(n, bits))
        near = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if near > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, near
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's place, its share of exp(-loss), and the lead in loss
        over the runner-up."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        best = loss.argmin(axis=1)
        low = loss.min(axis=1, keepdims=True)
        p = 1 / np.exp(low - loss).sum(axis=1)
        lead = np.partition(loss, 1, axis=1)[:, 1] - low[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return best, p, lead


def fit(x: np.ndarray, lang: list[str], steps: int = 250, ridge: float = 1e-5) -> Model:
    """Logistic regression per bit, all bits at once.  A bit's trust comes from
    how often it is right on every fourth row when fitted on the others."""
    langs = sorted(set(lang))
    code = codewords(len(langs))
    y = code[[langs.index(v) for v in lang]].astype("float32")
    held = np.arange(len(x)) % 4 == 3
    w, b = _regress(x[~held], y[~held], steps, ridge)
    right = ((x[held] @ w + b) * y[held] > 0).sum(axis=0)
    trust = np.maximum((2 * right + 1) / (held.sum() + 1) - 1, 0.01).astype("float64")
    w, b = _regress(x, y, steps, ridge)
    return Model(langs, code, w.astype("float64"), b.astype("float64"), trust)


def _regress(x: np.ndarray, y: np.ndarray, steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases per bit by Adam on all rows."""
    w = np.zeros((x.shape[1], y.shape[1]), "float32")
    b = np.zeros(y.shape[1], "float32")
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        gw, gb = x.T @ g / len(x) + ridge * w, g.mean(axis=0)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.3 * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= 0.3 * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return w, b


def sample(labelled: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` in all of (text, lang), as many of each language, by
    seeded hash of the text and id: languages beyond their share are thinned
    before they are ranked, so no task gets a large language whole."""
    per = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not per:
        return labelled.select("text", "lang")
    most = max(1, rows // len(per))
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(per.items()) for x in (lang, 1.5 * most / n)])
    thin = labelled.withColumn("_place", place).where(F.col("_place") <= F.element_at(share, F.col("lang")))
    ranked = thin.withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy("_place", "doc_id")))
    return ranked.where(F.col("_rank") <= most).select("text", "lang")


def train(labelled: DataFrame, sample_rows: int = 2400, seed: int = 3) -> Model | None:
    """Fit on (doc_id, text, lang), rows with null or empty text or null lang
    left out.  None without any row.  ``sample_rows`` bounds the rows that the
    fitting task gets (8 KB of features each)."""
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, part in grouped(batches, _GROUP):
            x = features(texts).astype("float16")
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(lang, x) for b in batches for lang, x in zip(b.column("lang").to_pylist(), b.column("x").to_pylist(), strict=True)]
        if got:
            got.sort()
            x = np.frombuffer(b"".join(x for _, x in got), "float16").reshape(len(got), BUCKETS).astype("float32")
            m = fit(x, [lang for lang, _ in got])
            yield pa.RecordBatch.from_arrays([pa.array([m.langs]), *[pa.array([v.tobytes()], pa.binary()) for v in (m.weights, m.bias, m.trust)]], names=["langs", "weights", "bias", "trust"])

    # one task fits the bounded sample; the model, a few hundred KB, comes to the driver
    made = sample(rows, sample_rows, seed).mapInArrow(count, "lang string, x binary").repartition(1).mapInArrow(fitted, "langs array<string>, weights binary, bias binary, trust binary").collect()
    if not made:
        return None
    weights, bias, trust = (np.frombuffer(made[0][c], "float64") for c in ("weights", "bias", "trust"))
    return Model(list(made[0]["langs"]), codewords(len(made[0]["langs"])), weights.reshape(BUCKETS, -1), bias, trust)


def identify(docs: DataFrame, model: Model | None, ambiguous_below: float = 0.7) -> DataFrame:
    """Adds ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_ambiguous`` to
    every row of ``docs``.  Texts that are null or have no letter get ``und``,
    score 0, not ambiguous; so does every text without a model.  Texts are
    whole, however long.  Repeated rows are scored alike.  All columns are kept;
    those named like the new ones are replaced.  An empty table stays empty."""
    base = docs.drop("lang_pred", "lang_score", "lang_ambiguous")
    columns = list(base.columns)
    schema = ", ".join(f"`{n}` {t}" for n, t in base.dtypes) + ", lang_pred string, lang_score double, lang_ambiguous boolean"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("language")
        for texts, part in grouped(batches, _GROUP):
            lang, p, close = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            known = [i for i, t in enumerate(texts) if model is not None and t and any(c.isalpha() for c in t)]
            if known:
                best, share, lead = model.decode(features([texts[i] for i in known]).astype("float64"))
                for i, k, s, d in zip(known, best.tolist(), share.tolist(), lead.tolist(), strict=True):
                    lang[i], p[i], close[i] = model.langs[k], s, d < ambiguous_below
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(lang), pa.array(p), pa.array(close)], names=[*columns, "lang_pred", "lang_score", "lang_ambiguous"])

    return base.mapInArrow(score, schema)
