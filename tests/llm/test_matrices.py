"""The n-gram join, ranked search and whitening against brute force, and on edge cases."""

import collections
import math
import re
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import ngram_join, registry, search, whitening
from tidemark.llm.shared import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = ["".join(letters) for letters in np.random.default_rng(7).choice(list("abcdefghij"), (2000, 6))]
EDGES = [None, "", " \t\n", "one", "ONE", "a b c d", "a b c d e", "A b c d e f", "x " * 3000, "x x x x x", "Grüße über die Straße und weiter so", "ÄÖ äö Ä ö é", "日本語 の 文章 です ね", "a,b;c-d'e f", "\x0b\x0c tab\tand\x1fmore"]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def edited(text, changes, seed):
    words, r = text.split(), np.random.default_rng(seed)
    for i in r.choice(len(words), changes, replace=False):
        words[i] = f"new{r.integers(10**9)}"
    return " ".join(words)


def frame(spark, texts, extra=()):
    rows = [(i, t, t, i % 3, 1.0, "x") for i, t in enumerate(texts)] + [(i, t, t, 0, 0.0, "y") for i, t in extra]
    return spark.createDataFrame(rows, "doc_id long, text string, tie string, node int, n double, score string").repartition(3)


def sets_of(text, shingle=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)) if len(words) >= shingle else frozenset([tuple(words)] if words else [])


def joined_plainly(rows, percent=80):
    """(doc_id, size, component) of each row, by comparing all pairs."""
    sets, parent = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), doc_id) if x is not None), default=None)
    return collections.Counter((doc_id, len(sets[i]), least[root(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def crowd():
    base, passage = prose(120, 1), prose(60, 2)
    texts = [base] * 4 + [edited(base, 3, s) for s in range(60)] + [edited(base, 12, 100 + s) for s in range(15)]
    texts += [f"{prose(25, 200 + s)} {passage} {prose(25, 300 + s)}" for s in range(40)] + [f"{passage} {prose(8, 400 + s)}" for s in range(20)]
    return texts + [prose(int(n), 500 + s) for s, n in enumerate(np.random.default_rng(3).integers(1, 40, 40))] + [prose(8, 900).rsplit(" ", k)[0] for k in range(1, 4)]


@pytest.mark.parametrize("settings", [{}, {"most": 2, "block_bytes": 3000, "column_grams": 200, "most_rows": 7}, {"most": 5, "most_bytes": 20_000}])
def test_join_matches_all_pairs(spark, settings):
    rows = [*enumerate([*crowd(), *EDGES]), (None, "no id at all here"), (None, "No id at all here"), (0, crowd()[0]), (3, "another text with an id that is taken")]
    docs = frame(spark, [t for i, t in rows[:-4]], rows[-4:])
    got = collections.Counter(tuple(r) for r in ngram_join.linked(docs, 5, **settings).collect())
    assert got == joined_plainly(rows)


@pytest.mark.parametrize("percent", [60, 95, 100])
def test_join_at_other_limits(spark, percent):
    rows = list(enumerate(crowd()))
    got = ngram_join.linked(frame(spark, [t for _, t in rows]), 5, Fraction(percent, 100), most=4).collect()
    assert collections.Counter(tuple(r) for r in got) == joined_plainly(rows, percent)


def test_join_at_the_limit(spark):
    """Of 9 n-grams 8 are shared: 0.8 exactly; of 8, 7: less."""
    words = prose(40, 11).split()
    texts = [" ".join(words[:13]), " ".join(words[:12] + ["z"]), " ".join(words[20:32]), " ".join(words[20:31] + ["z"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(frame(spark, texts), 5).collect()}
    assert got == {0: (9, 0), 1: (9, 0), 2: (8, 2), 3: (8, 3)}
    with pytest.raises(ValueError):
        ngram_join.linked(frame(spark, texts), 5, Fraction(1, 3))


def test_join_of_nothing(spark):
    assert ngram_join.linked(frame(spark, ["a"]).where("1 = 0")).collect() == []
    assert sorted(map(tuple, ngram_join.linked(frame(spark, [None, "", " "])).collect())) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def ranked_plainly(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    number, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in counted:
            m = 100 - 75 + 75 * sum(c.values()) * number // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, r + 1, doc_id, -score) for r, (score, _, doc_id) in enumerate(sorted(scores)[:k])]
    return collections.Counter(out)


@pytest.mark.parametrize("settings", [{}, {"shard_docs": 5}, {"shard_bytes": 300, "query_bytes": 200}])
def test_search_matches_scoring_of_all(spark, settings):
    rows = [*enumerate([*crowd(), *EDGES, *["same words here"] * 30]), (None, prose(120, 1)), (0, prose(120, 1))]
    docs = frame(spark, [t for _, t in rows[:-2]], rows[-2:])
    items = [(0, prose(120, 1)), (1, edited(prose(60, 2), 10, 1)), (2, "same SAME words"), (3, None), (4, ""), (5, "unheard"), (6, "x a b"), (6, "日本語 straße Straße"), (7, " ".join(VOCABULARY))]
    index = search.indexed(docs, **{k: v for k, v in settings.items() if k.startswith("shard")})
    found = search.searched(index, spark.createDataFrame(items, "item_id long, text string"), 10, **{k: v for k, v in settings.items() if k.startswith("query")})
    assert collections.Counter(tuple(r) for r in found.collect()) == ranked_plainly(rows, items)


@pytest.mark.parametrize("seed", range(4))
def test_trees_open_nodes_best_first(seed):
    """Exact top-k of many documents with ties, without opening all of the tree."""
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 12, 3000)
    terms = [np.unique(r.integers(0, 400, n).astype(np.uint64)) for n in sizes]
    counts = [r.integers(1, 4, len(t)) for t in terms]
    ids = [int(i) for i in r.permutation(10**6)[:3000]]
    tree = search.Tree(search._shard(ids, terms, counts, [int(c.sum()) for c in counts], 3000, int(sum(c.sum() for c in counts))))
    asked, weights = np.arange(0, 400, 7).astype(np.uint64), r.integers(0, 50, 58)
    norm = [25 + 75 * int(c.sum()) * 3000 // int(sum(x.sum() for x in counts)) for c in counts]
    by_term = dict(zip(asked.tolist(), weights.tolist()))
    scores = sorted((-sum(by_term.get(int(t), 0) * (10**9 * int(c) // (1000 * int(c) + 8 * m)) for t, c in zip(*x)), i) for *x, m, i in zip(terms, counts, norm, ids))
    opened = []
    bounds = tree._bounds
    tree._bounds = lambda levels, *a: opened.append(len(levels)) or bounds(levels, *a)
    got = [(-score, int(tree.doc_ids[o])) for score, o in tree.best(asked, weights, 10)]
    assert got == [s for s in scores[:10] if s[0] < 0]
    assert sum(opened) < 3000


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(frame(spark, ["a"]).where("1 = 0"), items).collect() == []
    assert search.search(frame(spark, [None, "", "?!"]), items).collect() == []
    assert search.search(frame(spark, ["a b"]), items.where("1 = 0")).collect() == []


def plain_whitening(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    values, vectors = np.linalg.eigh((z / n).T @ (z / n) / n)
    return n, (z * z).sum(axis=1), z / n, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("shape", [(200, 12), (40, 64), (500, 50), (300, 130)])
def test_whitening_matches_eigenvectors(spark, shape):
    r = np.random.default_rng(shape[1])
    vectors = (r.normal(size=shape) * np.geomspace(30, 0.5, shape[1])).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [1.0, None] + [0.0] * (shape[1] - 2), 1), (902, [float("nan")] * shape[1], 1), (903, [float("inf")] * shape[1], 1)]
    got = whitening.whitened(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n int").repartition(3), 32).toPandas()
    n, deviation, centred, values, directions = plain_whitening(vectors)
    k = min(32, shape[1], shape[0] - 1)
    assert len(got) == n * k and set(got.n) == {n}
    one = got[got.component == 1].set_index("vec_id")
    assert one.deviation.to_dict() == dict(enumerate(deviation.tolist()))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = centred @ directions[:, :k] / np.sqrt(values[:k])
    wide = wide * np.sign((wide * want).sum(axis=0))
    assert np.abs(wide - want).max() < 1e-7
    assert np.abs(got.groupby("component").explained.first().to_numpy() / (values[:k] / values.sum()) - 1).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_certifies_or_fails(spark):
    rows = written(whitening.whole_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(400, 200)))], "vec_id long, embedding array<double>")), "test-vectors")
    fit = whitening.fitted(rows, 8)
    assert fit.residual <= whitening.CERTIFIED * fit.values[0] and fit.steps > 2  # more dimensions than directions
    assert np.abs(fit.components.T @ fit.components - np.eye(8)).max() < 1e-12
    with pytest.raises(RuntimeError):
        whitening.fitted(rows, 8, steps=2)


def test_whitening_edge_cases(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string"), 4)
    assert make([(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")]).collect() == []  # no variance
    assert make([(1, None, "x")]).collect() == [] and make([(1, [], "x"), (2, [], None)]).collect() == []
    assert spark.createDataFrame([], "vec_id long, embedding array<double>").transform(whitening.whitened).collect() == []
    got = make([(None, [0.0, 1.0], "x"), (None, [0.0, 1.0], "x"), (3, [1.0], "x"), (4, [2.0, 2.0], "x")]).collect()  # a short one ends in zeros, repeated rows stay
    assert collections.Counter((r.vec_id, r.component) for r in got) == {(None, 1): 2, (None, 2): 2, (3, 1): 1, (3, 2): 1, (4, 1): 1, (4, 2): 1}
    large = make([(1, [1e15, 0.0], "x"), (2, [-1e15, 1.0], "x")]).collect()
    assert {r.deviation for r in large} == {None} and all(abs(r.whitened**2 - 1) < 1e-9 for r in large if r.component == 1)


def test_registered_queries_keep_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    got = {name: registry.queries()[name](spark, sf) for name in ("op11_ngram_join", "op12_search", "op13_whitening")}
    assert got["op11_ngram_join"].dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert got["op12_search"].dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert [c for c, _ in got["op13_whitening"].dtypes] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert collections.Counter(tuple(r) for r in got["op11_ngram_join"].collect()) == joined_plainly(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert collections.Counter(tuple(r) for r in got["op12_search"].collect()) == ranked_plainly(docs, items)
