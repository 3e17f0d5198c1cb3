"""Operators against second versions written from their definitions, on whole tables or dense fixtures."""

import random
import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from graphloom.llm import ecoc_langid, gbt_toxicity, mih_search, qda_quality, queries, soft_mixing, url_filter
from tests.conftest import SMALL

MEDIUM, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


class Classes:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while (p := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[p]
            x = p
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_op1_shards_and_slots(spark):
    rows = queries.op1_sharding(spark, MEDIUM).collect()
    text = {r.doc_id: (r.text or "").encode() for r in queries.table(spark, MEDIUM, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    shards = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert sum(map(len, shards)) == len(rows) and all(s == list(range(len(s))) for s in shards)
    assert max(map(len, shards)) - min(map(len, shards)) <= 1
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "rows", None) for r in rows)
    # a shuffle: places do not follow the identifiers, nor do shards
    ids, slots = np.array([(r.doc_id, r.slot) for r in rows]).T
    assert abs(np.corrcoef(ids, slots)[0, 1]) < 0.15


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_op4_by_brute_force(spark, folder):
    def fingerprint(text):
        words = []
        for word in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" "):
            words += [word] if word else []
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    docs = {r.doc_id: fingerprint(r.text) for r in queries.table(spark, folder, "documents").collect()}
    distinct = np.array(sorted(set(docs.values())), dtype=np.uint64)
    classes = Classes()
    for i, fp in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct[: i + 1] ^ fp) <= 2):
            classes.join(int(distinct[j]), int(fp))
    least = {}
    for doc, fp in docs.items():
        root = classes.find(fp)
        least[root] = min(least.get(root, doc), doc)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, folder).collect()}
    assert got == {doc: (f"{fp:016x}", least[classes.find(fp)]) for doc, fp in docs.items()}


def test_op5_by_formula():
    """Densities of the shrunk class covariances, by inverses and determinants."""
    rng = np.random.default_rng(5)
    d = len(qda_quality.NAMES)
    raw = np.abs(rng.standard_normal((400, d)) @ rng.standard_normal((d, d)))
    y = (raw[:, 0] + rng.standard_normal(400) > raw[:, 0].mean()).astype(int)
    model = qda_quality.train(raw, y, to_pooled=0.4, to_identity=0.1)
    x = qda_quality.transform(raw)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(own[c] * (y == c).sum() for c in (0, 1)) / len(y)
    density = []
    for c in (0, 1):
        s = 0.6 * own[c] + 0.4 * pooled
        s = 0.9 * s + 0.1 * np.trace(s) / d * np.eye(d)
        gap = z - z[y == c].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap) - 0.5 * np.linalg.slogdet(s)[1] + np.log(((y == c).sum() + 1) / (len(y) + 2)))
    assert np.allclose(model.margins(raw), density[1] - density[0], rtol=1e-5, atol=1e-5)


def test_op6_decoding_by_loops():
    """Loss-weighted decoding, language by language and bit by bit."""
    rng = np.random.default_rng(6)
    languages = list("abcde")
    code = ecoc_langid.codewords(5)
    model = ecoc_langid.Model(languages, code, rng.standard_normal((ecoc_langid.DIMENSIONS, code.shape[1])) * 5, rng.standard_normal(code.shape[1]), rng.random(code.shape[1]))
    for text in ("some words of a text", "ganz andere Wörter", "x"):
        counts = ecoc_langid.ngram_counts(text)
        x = np.sqrt(counts / counts.sum())
        loss = {}
        for i, language in enumerate(languages):
            loss[language] = 0.0
            for bit in range(code.shape[1]):
                margin = float(x @ model.weights[:, bit] + model.bias[bit])
                loss[language] += model.trust[bit] * np.log1p(np.exp(-margin * code[i, bit]))
        first, second = sorted(loss, key=loss.get)[:2]
        ((language, score, ambiguous),) = model.predict([text], ambiguous_gap=0.3)
        weights = {k: np.exp(-v) for k, v in loss.items()}
        assert language == first and np.isclose(score, weights[first] / sum(weights.values()), rtol=1e-4) and ambiguous == (loss[second] - loss[first] < 0.3)


def test_op6_bounded_sample(spark):
    """One identifier, null or not, brings no more rows than others; the total is bounded whatever the languages."""
    rows = [(None, f"wort nummer {i} hier", "de") for i in range(300)] + [(7, "the same text again", "en")] * 300 + [(i, f"plain words {i}", f"l{i % 30}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    train = ecoc_langid.train
    try:
        ecoc_langid.train = lambda x, y, languages, **kw: seen.append((len(x), len(languages))) or train(x, y, languages, rounds=2)
        ecoc_langid.fit(docs, total=320)
    finally:
        ecoc_langid.train = train
    assert seen[0][1] == 32 and 200 <= seen[0][0] <= 450
    assert ecoc_langid.codewords(500).shape[0] == 500 and len({tuple(r) for r in ecoc_langid.codewords(500)}) == 500


def f1(truth, predicted):
    truth, predicted = np.array(truth, dtype=bool), np.array(predicted, dtype=bool)
    return 2 * (truth & predicted).sum() / max(1, truth.sum() + predicted.sum())


def auc(truth, score):
    truth, score = np.array(truth, dtype=bool), np.array(score)
    return np.mean([(score[truth][:, None] > score[~truth]).mean() + 0.5 * (score[truth][:, None] == score[~truth]).mean()])


@pytest.mark.parametrize("query, label, rare", [(queries.op5_quality, "quality", 0), (queries.op8_toxicity, "toxic", 1)])
def test_held_out_quality_of_scores(spark, query, label, rare):
    """F1 of the rare class and area under the curve on held-out labels: what a constant answer cannot reach."""
    said = {r.doc_id: r[label] for r in queries.table(spark, LARGE, "labels").collect()}
    rows = [r for r in query(spark, LARGE).collect() if r.held_out and r.doc_id in said]
    truth = [said[r.doc_id] == rare for r in rows]
    assert sum(truth) > 50
    assert f1(truth, [r.predicted == rare for r in rows]) > 0.9
    assert auc(truth, [r.score if rare else -r.score for r in rows]) > 0.98


def test_op8_isotonic_by_formula():
    """The rising fit is the largest of all least means: max over begins of the min over ends."""
    rng = np.random.default_rng(8)
    margin = np.round(rng.standard_normal(60), 1)  # with ties
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    values = np.unique(margin)
    sums = np.array([[y[margin == v].sum(), (margin == v).sum()] for v in values])
    mean = lambda i, j: sums[i : j + 1, 0].sum() / sums[i : j + 1, 1].sum()
    want = [max(min(mean(i, j) for j in range(k, len(values))) for i in range(k + 1)) for k in range(len(values))]
    at, value = gbt_toxicity.isotonic(margin, y)
    levels = sorted(set(np.round(want, 9)))
    assert len(at) == len(levels) and (np.diff(at) > 0).all() and (np.diff(value) >= 0).all()
    inner = [v for v in levels if 0.05 < v < 0.95]
    assert all(np.isclose(value, v).any() for v in inner)


def test_op8_splits_by_search():
    """The first tree's root, by trying every feature and cut."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 12, (200, 3)).astype(float)
    y = ((x[:, 1] > 6) | (rng.random(200) < 0.1)).astype(float)
    made = gbt_toxicity.boost(x, y, trees=1, depth=1, rate=1.0, penalty=1.0, least=2.0)
    p = np.full(200, 1 / (1 + np.exp(-made.start)))
    assert np.isclose(p[0], y.mean(), atol=0.01)
    g, h = p - y, p * (1 - p)
    score = lambda at: g[at].sum() ** 2 / (h[at].sum() + 1)
    best = max((score(x[:, j] <= c) + score(x[:, j] > c), j, c) for j in range(3) for c in range(11) if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= 2)
    j, cut = int(made.features[0][0]), made.cuts[0][0]
    assert j == best[1] and ((x[:, j] <= cut) == (x[:, j] <= best[2])).all()
    low = x[:, j] <= cut
    assert np.allclose(sorted(made.leaves[0]), sorted(-g[s].sum() / (h[s].sum() + 1) for s in (low, ~low)))


def dense_solver(p, tokens, targets, rounds=200_000):
    """Plain projected gradient on the same least squares, without any preconditioning."""
    a = (p * tokens[:, None]).T
    r, step = np.ones(len(tokens)), 1 / np.linalg.norm(a @ a.T, 2)
    for _ in range(rounds):
        r = np.maximum(0, r - step * (a.T @ (a @ r - targets)))
    return a @ r


def test_op9_against_a_second_solver(spark):
    """Targets that no rates reach: the nearest totals are those that a dense solver finds."""
    rng = np.random.default_rng(10)
    p = 0.25 + 0.25 * rng.dirichlet([0.5, 0.5, 0.5], 40)  # every document is at least a quarter of each domain
    tokens = rng.integers(5, 50, 40)
    rows = spark.createDataFrame([(int(t), [float(x) for x in a]) for t, a in zip(tokens, p)], "tokens long, p array<double>")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        fitted = soft_mixing.fit_rates(rows, 3, [0.9, 0.05, 0.05], rounds=120)
    assert not fitted.converged and any("targets missed" in str(w.message) for w in said)
    want = dense_solver(p, tokens.astype(float), np.array(fitted.targets))
    miss = lambda t: ((np.array(t) - fitted.targets) ** 2).sum()
    assert miss(fitted.totals) <= 1.1 * miss(want) + 1e-6
    rates = np.array([r[0] for r in rows.select(fitted.rate()).collect()])
    assert np.allclose((p * (tokens * rates)[:, None]).sum(axis=0), fitted.totals)


def test_op9_many_domains(spark):
    """All of 150 domains are learnt, and their totals met."""
    k = 150
    rng = random.Random(11)
    rows = [(i, " ".join([f"only{i % k}"] * 6 + [f"w{rng.randrange(500)}" for _ in range(20 + i % k)]), f"d{i % k:03}") for i in range(12 * k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = soft_mixing.fit(docs, docs.select("doc_id", "domain"))
    assert model.domains == [f"d{i:03}" for i in range(k)]
    p = np.eye(k) * 0.9 + 0.1 / k
    post = spark.createDataFrame([(10, [float(x) for x in p[i % k]]) for i in range(2 * k)], "tokens long, p array<double>")
    fitted = soft_mixing.fit_rates(post, k, [1.0 + i % 3 for i in range(k)], tolerance=1e-4)
    assert fitted.converged and np.allclose(fitted.totals, fitted.targets, atol=0.5)


@pytest.mark.parametrize("k", [16, 17, 40])
def test_op9_mixed_posteriors_of_many_domains(spark, k):
    """Dirichlet posteriors, so that every document counts for every domain: the targets are met whatever the number of domains."""
    rng = np.random.default_rng(k)
    rows = [(int(rng.integers(5, 300)), [float(x) for x in rng.dirichlet(np.full(k, 0.4))]) for _ in range(400)]
    fitted = soft_mixing.fit_rates(spark.createDataFrame(rows, "tokens long, p array<double>"), k, [1.0 + i % 3 for i in range(k)])
    assert fitted.converged and fitted.error <= 1e-7 and len(fitted.steps) < 25


def test_op9_without_labels_or_weights(spark, odd_docs, recwarn):
    none = spark.createDataFrame([], "doc_id long, domain string")
    some = spark.createDataFrame([(4, "a"), (6, "b"), (7, None), (8, "c")], "doc_id long, domain string")
    for labels, weights in ((none, {"a": 1.0}), (some, {"zz": 1.0}), (some, {})):
        rows = soft_mixing.document_rates(odd_docs, labels, weights).collect()
        assert len(rows) == 10 and all(r.rate == 1 and r.copies == 1 for r in rows)
        assert soft_mixing.mix(odd_docs, labels, weights).count() == 10
    rows = soft_mixing.document_rates(odd_docs, some, {"a": 1.0}).collect()
    assert all(np.isfinite(r.rate) and r.rate >= 0 for r in rows)
    with pytest.raises(ValueError):
        soft_mixing.document_rates(odd_docs, some, {"a": -1.0})
    assert not [w for w in recwarn if issubclass(w.category, RuntimeWarning)]
    odd = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 1, None), (4, 0, 0), (5, None, 1), (6, 7, 0)], "doc_id long, quality int, toxic int")
    assert [r.domain for r in queries.label_domains(odd).orderBy("doc_id").collect()] == ["clean", None, None, "junk", "toxic", None]


def test_op10_recall_and_share(spark):
    """Every query has its five rows; recall of the shipped query; the share of rows that the probes leave to the full check."""
    table = queries.table(spark, LARGE, "embeddings")
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table.collect()}
    ids = np.array(sorted(vectors))
    unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    found = {}
    for r in queries.op10_ann(spark, LARGE).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(found) == asked and all(len(set(v)) == 5 for v in found.values())
    hits = 0
    for q in asked:
        score = unit @ unit[np.searchsorted(ids, q)]
        score[np.searchsorted(ids, q)] = -9
        hits += len(set(found[q]) & set(ids[np.argsort(-score, kind="stable")[:5]].tolist()))
    assert hits / (5 * len(asked)) >= 0.9
    codes = mih_search.fit(unit[:: max(1, len(unit) // 5000)])
    block = mih_search.BlockIndex(codes, ids, unit)
    shares = [block.probed(block.packed[i]).mean() for i in range(0, len(ids), len(ids) // 50)]
    # the supplied vectors are nearly random: no radius that finds the nearest leaves much out
    assert 0.5 < np.mean(shares) <= 1
    # vectors in clusters: probes leave most rows out
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((60, 64)) * 4
    near = centres[rng.integers(0, 60, 6000)] + 0.1 * rng.standard_normal((6000, 64))
    codes = mih_search.fit(near)
    block = mih_search.BlockIndex(codes, np.arange(6000), near)
    assert np.mean([block.probed(block.packed[i]).mean() for i in range(0, 6000, 200)]) < 0.3


RULES = [("good.org", "/", "allow"), ("bad.org", "/", "block"), ("mixed.org", "/x/", "block"), ("mixed.org", "/y/", "allow")]


def test_op2_classes_by_union_find(spark):
    """Classes of thousands of pages: a chain of canonical links, a star of redirects, and random links."""
    rng = random.Random(13)
    url = lambda i: f"http://h{i % 97}.net/p{i}"
    link = lambda to: f"<html><head><link rel='alternate' href='http://no.where/'><link href=\"{to}\" rel=\"nofollow CANONICAL\"></head></html>"
    refresh = lambda to: f'<meta http-equiv="Refresh" content="3;URL={to}">'
    pages, target = [], {}
    for i in range(2000):  # a chain that ends at a blocked page
        target[i] = url(i + 1) if i < 1999 else "https://bad.org/end"
    for i in range(2000, 4000):  # a star whose hub redirects to a page that is allowed and one that is blocked
        target[i] = url(2000) if i > 2000 else "http://mixed.org/x/1"
    more = {2001: "http://mixed.org/y/1"}  # a canonical link besides
    for i in range(4000, 5500):
        target[i] = url(rng.randrange(4000, 5500)) if rng.random() < 0.4 else "http://good.org/z" if rng.random() < 0.002 else None
    for i in range(5500):
        both = refresh(target[i]) + link(more[i]) if i in more else None
        pages.append((i, url(i), both or ((link if i % 2 else refresh)(target[i]) if target[i] else "<p>none</p>")))
    classes, rule = Classes(), {}
    for i, u, _ in pages:
        if target[i]:
            classes.join(u.split("://")[1], target[i].split("://")[1])
    verdicts = {}
    for i, to in more.items():
        classes.join(url(i).split("://")[1], to.split("://")[1])
    for u in [*target.values(), *more.values()]:
        for host, path, verdict in RULES:
            if u and u.split("://")[1].startswith(host + path):
                verdicts.setdefault(classes.find(u.split("://")[1]), set()).add(verdict)
    want = {i: ("allow" if "allow" in v else "block" if v else "allow", "alias" if v else "default") for i, u, _ in pages for v in [verdicts.get(classes.find(u.split("://")[1]), set())]}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.verdict, r.via) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == want and sum(v == ("block", "alias") for v in want.values()) == 2000 and sum(v == ("allow", "alias") for v in want.values()) >= 2000


@pytest.mark.parametrize(
    "html, target",
    [
        ('<link rel="alternate canonical" href="/t">', "http://a.com/t"),
        ("<LINK HREF='/t' REL=Canonical>", "http://a.com/t"),
        ('<link data-rel="canonical" href="/t">', None),
        ('<link title="rel=canonical" href="/t">', None),
        ('<link title="a>b" rel="canonical" href="/t">', "http://a.com/t"),
        ('<link rel="canonical" href="/t?a=1&amp;b=2">', "http://a.com/t?a=1&b=2"),
        ('<link rel="canonical" href="/t&#x2F;&#252;&amp;#38;">', "http://a.com/t/ü&#38;"),
        ('<!-- <link rel="canonical" href="/no"> --><link rel="canonical" href="/t">', "http://a.com/t"),
        ("<script>var s = '<link rel=\"canonical\" href=\"/no\">'</script>", None),
        ('<!-- open <link rel="canonical" href="/no">', None),
        ('<link rel="stylesheet" href="/no"><link rel="canonical" href="t">', "http://a.com/d/e/t"),
        ('<link rel="canonical">', None),
        ('<link rel="canonical" href="../../t">', "http://a.com/d/e/../../t"),
        ('<meta http-equiv=refresh content="0; url=\'/t\'">', "http://a.com/t"),
        ('<meta http-equiv="refresh" content="5">', None),
        ('<meta name="refresh" content="0;url=/t">', None),
        ("", None),
    ],
)
def test_op2_links(spark, html, target):
    df = spark.createDataFrame([("http://a.com/d/e/f", html)], "url string, html string")
    assert [r.to_url for r in url_filter.page_links(df).collect()] == ([target] if target else [])


def test_op2_addresses(spark):
    cases = {"http://A.com": "a.com", "http://a.com/d/e/../../t": "a.com/t", "http://a.com/./x/..": "a.com/", "http://a.com/a/b/..": "a.com/a/", "http://a.com/../../t?q=/../x#f": "a.com/t?q=/../x", "no": None, "https://a.com/a..b/.c": "a.com/a..b/.c"}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.node for r in df.select("url", url_filter.address(F.col("url")).alias("node")).collect()} == cases


def test_op2_long_pages_and_many_rules(spark, monkeypatch):
    """Megabytes of markup that never closes; rules joined through a shuffle give what broadcast ones give."""
    long = ["<link " + "a='b' " * 200_000, "<!-- " * 200_000, "<link rel='canonical' href='" + "x" * 500_000, "<" * 300_000 + "canonical refresh"]
    df = spark.createDataFrame([("http://a.com/", h + " canonical refresh") for h in long], "url string, html string")
    assert url_filter.page_links(df).count() == 0
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "/x", "block"), ("b.a.com", "/xy", "allow")], "host string, path string, verdict string")
    urls = spark.createDataFrame([(h, p) for h in ("a.com", "b.a.com", "c.com", "d.net") for p in ("/", "/x", "/xyz", "")] * 50, "host string, path string")
    plain = sorted(map(tuple, url_filter.match_rules(urls, rules).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, url_filter.match_rules(urls, rules).collect())) == plain and len(plain) == 9
