import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import langid, ppm, toxicity
from corpusflow.llm.common import crc_mod, split_of
from corpusflow.llm.langid import codewords, features, fit, identify, train
from corpusflow.llm.ppm import Adaptive, Trie, score, tokens
from corpusflow.llm.toxicity import Index, monotone, score_toxicity

LANGS = {
    "en": "the of and to in that is was for with as on be by this from are which have not there".split(),
    "de": "der die und das von zu mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "le de la les et des en un du une que est pour qui dans par plus pas au sur".split(),
}


def sentence(lang, seed, n=30):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(LANGS[lang], n))


def test_split_is_crc32(spark):
    ids = [0, 1, 7, 123456, -5]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(split_of(F.col("i"), 7)).collect()
    assert [r[0] for r in got] == [crc_mod(i, 7) for i in ids]


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 30])
def test_codewords_differ(n):
    c = codewords(n)
    assert len({tuple(r) for r in c}) == n
    assert set(np.unique(c)) == {-1.0, 1.0}


@pytest.mark.parametrize("n,least", [(7, 12), (8, 12), (12, 14), (20, 16)])
def test_codewords_are_far_apart(n, least):
    c = codewords(n)
    assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= least


@pytest.mark.parametrize("n", [2, 4, 8, 20])
def test_decoding_is_its_definition(n):
    r = np.random.default_rng(n)
    langs = [f"l{i:02d}" for i in range(n)]
    words = {v: ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for v in langs}
    texts = [(v, " ".join(r.choice(words[v], 20))) for v in langs for _ in range(20)]
    model = fit(features([t for _, t in texts]), [v for v, _ in texts], steps=60)
    x = features([" ".join(r.choice(words[v], 9)) for v in langs]).astype(float)
    best, share, lead = model.decode(x)
    for i, row in enumerate(x):
        margin = [float(sum(row * model.weights[:, b]) + model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margin, word)) for word in model.code]
        order = sorted(range(n), key=lambda k: loss[k])
        assert best[i] == order[0] == i and lead[i] == pytest.approx(loss[order[1]] - loss[order[0]])
        assert share[i] == pytest.approx(math.exp(-loss[order[0]]) / sum(math.exp(-v) for v in loss))
    assert (model.trust >= 0.01).all() and (model.trust < 1).all()


def test_features_do_not_mix_texts(monkeypatch):
    texts = ["one text", "", "Ünrelated WORDS", "x" * 5000]
    whole = features(texts)
    monkeypatch.setattr(langid, "PIECE", 7)  # texts in pieces
    assert np.allclose(features(texts), whole)
    together = features(texts)
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(features([t])[0], row)


def test_languages(spark, rough, none):
    rows = [(i, sentence(x, i), x) for i, x in enumerate(list(LANGS) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df.where("doc_id < 120"), sample_rows=90)
    got = identify(df.where("doc_id >= 120"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    rows = identify(rough, model).collect()
    assert len(rows) == rough.count() and set(rough.columns) < set(rows[0].asDict())
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {1, 2, 3, 5} <= und and 4 not in und and 10 not in und
    assert all(0 <= r.lang_score <= 1 for r in rows)
    assert identify(none, model).count() == 0
    assert train(none) is None and {r.lang_pred for r in identify(rough, None).collect()} == {"und"}


def test_one_language_is_always_it(spark):
    model = fit(features(["abc def"]), ["en"], steps=2)
    assert model.langs[int(model.decode(features(["xyz"]).astype(float))[0][0])] == "en"


@pytest.mark.parametrize("postings", [1 << 20, 50])
def test_nearest_is_exact(monkeypatch, postings):
    monkeypatch.setattr(toxicity, "POSTINGS", postings)
    r = np.random.default_rng(3)
    weight = np.r_[r.random(39) * 5, 0.0]
    pick = lambda n: [np.sort(r.choice(40, r.integers(0, 9), replace=False)) for _ in range(n)]
    packed = lambda xs: (np.r_[0, np.cumsum([len(x) for x in xs])], np.concatenate(xs).astype(int), np.concatenate([1.0 + x % 3 for x in xs]))
    examples, texts = pick(300), pick(80)
    examples[200:230] = [examples[7]] * 30  # ties

    def dense(xs):
        out = np.zeros((len(xs), 40))
        for i, x in enumerate(xs):
            out[i, x] = (1 + np.log(1.0 + x % 3)) * weight[x]
        return out / np.maximum(1e-300, np.sqrt((out**2).sum(axis=1)))[:, None]

    cos = (dense(texts) @ dense(examples).T).round(11)
    for block, common in ((8, 0.05), (32, 2.0), (5, 0.0)):
        index = Index.build(weight, r.integers(0, 2, 300).astype(float), np.arange(300), packed(examples), block=block, common=common)
        found, got = index.nearest(packed(texts), 9)
        for i in range(80):
            want = np.lexsort((np.arange(300), -cos[i]))[:9]
            want = want[cos[i][want] > 0]
            assert found[i][got[i].round(11) > 0].tolist() == want.tolist() and np.allclose(got[i][: len(want)], cos[i][want])


def test_terms():
    words = ["abcdef", "abcde", "abc", "x" * 40, "x" * 41, "été", "étéétéé"]
    rows = toxicity.term_hashes(words)
    assert rows[0][1] == rows[1][1] != 0 and rows[2][1] == 0 != rows[2][0]
    assert len(np.unique(rows[:, 0])) == len(words) and np.array_equal(toxicity.term_hashes(words[3:4])[0], rows[3])
    texts = ["One two, abcdef ABCDE one!", "", None, "étéétéé one_two " * 3]
    terms = toxicity.Terms(toxicity.Terms().hashes(texts), most=3)
    for _ in range(3):
        start, ids, tfs = terms.counts(texts)
        for i, t in enumerate(texts):
            want = Counter(x for w in toxicity._TOKEN.findall((t or "").lower()) for x in toxicity.terms_of(w))
            assert sorted(tfs[start[i] : start[i + 1]].tolist()) == sorted(want.values())
            assert (np.diff(ids[start[i] : start[i + 1]]) > 0).all()


def plain_toxicity(texts, labelled, k):
    """Votes by the definition: dictionaries and dense cosines."""
    bags = [Counter(x for w in toxicity._TOKEN.findall((t or "").lower()) for x in toxicity.terms_of(w)) for t in texts]
    df = Counter(x for b in bags for x in b)
    n = {y: sum(v == y for v in labelled.values()) for y in (0, 1)}
    seen = {y: Counter(x for i, v in labelled.items() if v == y for x in bags[i]) for y in (0, 1)}

    def weight(x):
        if not seen[0][x] + seen[1][x]:
            return 0.0
        clean, toxic = (math.log((seen[y][x] + n[y] / sum(n.values())) / (n[y] + 1)) for y in (0, 1))
        return (math.log((1 + len(texts)) / (1 + df[x])) + 1) * abs(toxic - clean)

    vecs = []
    for b in bags:
        v = {x: (1 + math.log(c)) * weight(x) for x, c in b.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        vecs.append({x: w / norm for x, w in v.items() if norm})
    out = []
    for v in vecs:
        cos = sorted(((round(sum(w * vecs[e].get(x, 0.0) for x, w in v.items()), 11), -e) for e in labelled), reverse=True)[:k]
        cos = [(c, -e) for c, e in cos if c > 0]
        out.append(sum(c * labelled[e] for c, e in cos) / sum(c for c, _ in cos) if cos else 0.0)
    return out


def test_monotone():
    v, s = monotone(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert np.allclose(s, [0, 0.5, 1]) and (np.diff(v) > 0).all()


@pytest.fixture(scope="module")
def insults(spark):
    r = np.random.default_rng(5)
    bad = ["vilecur", "vilepox", "gutterrat", "gutterfly"]
    rows = []
    for i in range(400):
        toxic = int(i % 5 == 0)
        words = [*r.choice(LANGS["en"], 40), *(r.choice(bad, 2) if toxic else [])]
        r.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark, insults, rough, none):
    got = score_toxicity(insults.drop("toxic"), insults.where("doc_id < 250").select("doc_id", "toxic"), k=9).join(insults.select("doc_id", "toxic"), "doc_id").where("doc_id >= 250").collect()
    assert all((x.score >= 0.7) == (x.toxic == 1) for x in got)
    assert all(len(x.evidence) == 3 and x.evidence[0].toxic == x.toxic for x in got)
    labels = spark.createDataFrame([(6, 1), (6, 0), (7, 0), (8, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    rows = score_toxicity(rough, labels).collect()
    assert len(rows) == rough.count() and all(0 <= x.score <= 1 for x in rows)
    assert score_toxicity(none, labels).count() == 0
    assert {x.score for x in score_toxicity(rough, labels.limit(0)).collect()} == {0.0}


def test_toxicity_is_its_definition(spark, insults, tmp_path):
    """Scores of whole texts against votes by definition, put through the
    regression of votes that plain folds give."""
    rows = [*insults.limit(120).collect(), (400, None, 0), (401, "", 0), (402, "unheardof", 0)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labelled = {r[0]: r[2] for r in rows if r[0] < 60}
    got = {x.doc_id: x for x in score_toxicity(docs, spark.createDataFrame(list(labelled.items()), "doc_id long, toxic int"), k=7).collect()}
    texts = [r[1] for r in rows]
    places = {r[0]: i for i, r in enumerate(rows)}
    at = {places[i]: y for i, y in labelled.items()}
    plain = plain_toxicity(texts, at, 7)
    fold = {e: n % 4 for y in (0, 1) for n, e in enumerate(sorted(e for e, v in at.items() if v == y))}
    held = [plain_toxicity(texts, {e: y for e, y in at.items() if fold[e] != f}, 7) for f in range(4)]
    order = sorted(at)
    v, share = monotone(np.array([held[fold[e]][e] for e in order]), np.array([float(at[e]) for e in order]), np.ones(len(order)))
    for r in rows:
        want = plain[places[r[0]]]
        assert got[r[0]].score == pytest.approx(min(1, max(0, 0.99 * float(np.interp(want, v, share)) + 0.01 * want)), abs=1e-6)


def test_sample_of_repeated_ids(spark, insults):
    twice = insults.drop("toxic").unionByName(insults.drop("toxic")).unionByName(spark.createDataFrame([(0, "other text")] * 50, "doc_id long, text string"))
    got = score_toxicity(twice, insults.select("doc_id", "toxic"), most_toxic=40, most_clean=60).groupBy("doc_id").count().collect()
    assert {r["count"] for r in got if r.doc_id} == {2} and len(got) == 400


def simple_ppm(counts, words, order):
    """The model by its definition: dictionaries, one symbol at a time."""
    nodes = {}
    spell = lambda w: [ppm.END] if w == b"" else [*w, ppm.CLOSE]
    for w, n in counts.items():
        past = (ppm.CLOSE,)
        for s in spell(w):
            for d in range(min(order, len(past)) + 1):
                node = nodes.setdefault(past[len(past) - d :], Counter())
                node[s] += n
            past = (*past, s)
    out = []
    for w in words:
        total, past = 0.0, (ppm.CLOSE,)
        for s in spell(w):
            gone = set()
            for d in range(min(order, len(past)), -1, -1):
                node = {k: n for k, n in nodes.get(past[len(past) - d :], {}).items() if k not in gone}
                if not node:
                    continue
                n = sum(node.values()) + len(node)
                if s in node:
                    total += math.log10(node[s] / n)
                    break
                total += math.log10(len(node) / n)
                gone |= set(node)
            else:
                total -= math.log10(ppm.SYMBOLS - len(gone))
            past = (*past, s)
        out.append(total)
    return out


@pytest.mark.parametrize("order", [0, 1, 2, 4, 6])
def test_trie_is_the_model(spark, order):
    counts = {b"the": 9, b"then": 2, b"thin": 3, b"at": 5, b"\xc3\xa9t\xc3\xa9": 1, b"aaaaaaaaaa": 2, b"": 4}
    df = spark.createDataFrame([(w, n) for w, n in counts.items() if w], "word binary, c long")
    trie = ppm.train(df, counts[b""], order)
    words = [b"the", b"thinner", b"zzz", b"", b"\xff\x00", b"aaaaaaaaaaaa", b"t"]
    assert np.allclose(trie.log10(words), simple_ppm(counts, words, order))


def test_probabilities_add_up():
    trie = Trie(np.empty(0, np.uint64), np.empty(0), 3)
    assert np.allclose(trie.log10([b"a"])[0], -2 * math.log10(ppm.SYMBOLS))


def test_adaptive_learns():
    model = Adaptive(4)
    first = model.log10("the same words again")
    assert model.log10("the same words again") > first
    assert Adaptive().log10(None) == Adaptive().log10("") < 0


def test_adaptive_scores(spark, rough, none):
    some = rough.where("doc_id is null or doc_id <> 6")
    rows = ppm.adaptive(some, 3).collect()
    assert len(rows) == some.count() and ppm.adaptive(none).count() == 0
    want = Counter((r.doc_id, round(Adaptive(3).log10(r.text), 9)) for r in some.collect())
    assert Counter((r.doc_id, round(r.score, 9)) for r in rows) == want


def test_scores(spark, rough, none):
    training = rough.where("doc_id % 3 <> 0")
    rows = score(rough, training, frequent=10).collect()
    assert len(rows) == rough.count()
    texts = [r.text for r in training.collect()]
    counts = Counter(w for t in texts for w in tokens(t))
    n, v = sum(counts.values()) + len(texts), len(counts) + 1
    one = lambda c: math.log10((c + 1) / (n + v + 1))
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for r in rough.where("doc_id is not null").collect():
        w = tokens(r.text)
        x = by[r.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w) + 1, sum(counts[y] > 0 for y in w) + 1, n)
        assert x.base_score == pytest.approx(sum(one(counts[y]) for y in w) + one(len(texts)))
        assert x.score < 0
    assert score(none, training).count() == 0
    empty = score(rough.where("doc_id = 4"), none).collect()[0]
    assert (empty.n_known, empty.train_tokens) == (0, 0)
    assert empty.score == pytest.approx(-6 * math.log10(ppm.SYMBOLS))


def stream_ppm(training, texts, order):
    """As simple_ppm, over texts in sequence."""
    nodes = {}
    spell = lambda words: [s for w in words for s in (*w, ppm.CLOSE)] + [ppm.END]
    for words in training:
        past = (ppm.CLOSE,)
        for s in spell(words):
            for d in range(min(order, len(past)) + 1):
                nodes.setdefault(past[len(past) - d :], Counter())[s] += 1
            past = (*past, s)[-order:]
    out = []
    for words in texts:
        total, past = 0.0, (ppm.CLOSE,)
        for s in spell(words):
            gone = set()
            for d in range(min(order, len(past)), -1, -1):
                node = {k: n for k, n in nodes.get(past[len(past) - d :], {}).items() if k not in gone}
                if not node:
                    continue
                n = sum(node.values()) + len(node)
                if s in node:
                    total += math.log10(node[s] / n)
                    break
                total += math.log10(len(node) / n)
                gone |= set(node)
            else:
                total -= math.log10(ppm.SYMBOLS - len(gone))
            past = (*past, s)[-order:]
        out.append(total)
    return out


@pytest.mark.parametrize("held", [0, 200, 10**6])
def test_scores_are_the_models_at_full_order(spark, rough, held):
    docs = rough.where("doc_id is not null and doc_id not in (6, 10)")
    training = docs.where("doc_id % 3 <> 0")
    got = {r.doc_id: r.score for r in score(docs, training, held=held).collect()}
    rows = docs.collect()
    plain = stream_ppm([tokens(r.text) for r in training.collect()], [tokens(r.text) for r in rows], 6)
    assert [got[r.doc_id] for r in rows] == pytest.approx(plain)


def test_order_of_words_matters(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text), (2, "six three eight one five two seven four")], "doc_id long, text string")
    got = {r.doc_id: r for r in score(docs, spark.createDataFrame([(text,)] * 3, "text string")).collect()}
    assert got[1].base_score == pytest.approx(got[2].base_score) and got[1].score > got[2].score + 1


class Tasks:
    """Stands for a DataFrame and keeps what its tasks would run."""

    def __init__(self, spark):
        self.sparkSession, self.run = spark, []

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        self.run.append(function)
        return self

    def repartitionById(self, *_):
        return self


@pytest.fixture
def counting(spark, monkeypatch):
    monkeypatch.setattr(ppm, "durable", lambda df, *_, **__: df)
    return lambda words=0: ppm.key_counts(Tasks(spark), 6, words).run


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_counting_long_texts_takes_little_memory(counting):
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 80_000).tolist())) for _ in range(20)]
    batch, got = pa.RecordBatch.from_pydict({"text": texts}), []

    def run():
        for b in counting()[0](iter([batch])):
            got.append(sum(len(k) // 8 for k in b.column("k").to_pylist()))

    assert peak(run) < 300
    assert sum(got) > 1_000_000


def test_merging_a_parts_counts_takes_little_memory(counting):
    keys = np.arange(100_000, dtype="uint64") * 977
    batch = pa.RecordBatch.from_pydict({"part": [0], "k": [keys.tobytes()], "n": [np.full(len(keys), 3, "int32").tobytes()]})
    k, n = [], []

    def run():
        for b in counting()[1](batch for _ in range(60)):
            k.extend(b.column("k").to_pylist())
            n.extend(b.column("n").to_pylist())

    assert peak(run) < 100
    assert k == keys.tolist() and set(n) == {180}


def test_a_frequent_context_is_not_one_part(counting):
    rng = np.random.default_rng(6)
    text = " ".join("".join(map(chr, x)) + "eee" for x in rng.integers(97, 123, (50_000, 2)).tolist())
    parts = Counter()
    for b in counting(10**8)[0](iter([pa.RecordBatch.from_pydict({"text": [text]})])):
        for part, k in zip(b.column("part").to_pylist(), b.column("k").to_pylist(), strict=True):
            parts[part] += len(k) // 8
    assert max(parts.values()) < 0.08 * sum(parts.values())


@pytest.mark.parametrize("text", [None, "", " ", "a", "One  two\nthree é five a b c d e f g h i j k l m n o p q r s"])
def test_keys_of_a_text_in_pieces(monkeypatch, text):
    whole = ppm.stream_keys([tokens(text)], 6)[0].tolist()
    for piece in (1, 2, 5, 100):
        monkeypatch.setattr(ppm, "PIECE", piece)
        assert np.concatenate(list(ppm._group_keys([text], 6))).tolist() == whole
