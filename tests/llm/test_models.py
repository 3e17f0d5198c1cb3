"""Classifiers by held-out accuracy, mixing and search by brute force, the pipeline by its rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import ecoc_langid, gbt_toxicity, mih_search, qda_quality, queries, set_join, soft_mixing
from tests.conftest import SMALL

MEDIUM = "/root/testdata/sf0.01"


def held_out(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


def test_langid(spark):
    lang = {r.doc_id: r.lang for r in queries.table(spark, MEDIUM, "documents").collect()}
    rows = queries.op6_langid(spark, MEDIUM).collect()
    assert len(rows) == len(lang) and all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_langid_odd_rows(spark, odd_docs, no_docs):
    model = ecoc_langid.fit(odd_docs)
    got = ecoc_langid.identify(odd_docs, model)
    assert got.columns == [c for c in odd_docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score", "ambiguous"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 8)) and by[6]["lang_pred"] in ("en", "de", "fr", "xx")
    assert ecoc_langid.identify(no_docs, ecoc_langid.fit(no_docs)).count() == 0
    assert {r["lang_pred"] for r in ecoc_langid.identify(odd_docs, ecoc_langid.fit(no_docs)).collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 9, 40])
def test_codewords_differ(k):
    code = ecoc_langid.codewords(k)
    assert code.shape[0] == k and len({tuple(r) for r in code}) == k
    if k > 2:
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= max(2, code.shape[1] // 4)


def test_ngrams_in_blocks(monkeypatch):
    text = "Ein längerer Text, mit 123 Zeichen! " * 50
    whole = ecoc_langid.ngram_counts(text)
    assert whole.sum() > len(text) and ecoc_langid.ngram_counts("123 !") is None
    monkeypatch.setattr(ecoc_langid, "_BLOCK", 64)
    assert np.abs(ecoc_langid.features(ecoc_langid.ngram_counts(text)) - ecoc_langid.features(whole)).max() < 0.1


def test_quality(spark):
    label = {r.doc_id: r.quality for r in queries.table(spark, MEDIUM, "labels").collect()}
    rows = queries.op5_quality(spark, MEDIUM).collect()
    assert len(rows) == 1000 and all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in rows if r.held_out and r.doc_id in label]) > 0.95


def test_toxicity(spark):
    label = {r.doc_id: r.toxic for r in queries.table(spark, MEDIUM, "labels").collect()}
    rows = queries.op8_toxicity(spark, MEDIUM).collect()
    assert len(rows) == 1000 and all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in test]) > 0.93


@pytest.mark.parametrize("module", [qda_quality, gbt_toxicity])
def test_classifiers_odd_rows(spark, module, odd_docs, no_docs):
    said = spark.createDataFrame([(4, 1, 1), (6, 0, 0), (7, 1, 1), (8, 0, 0), (8, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for labels in (said, said.limit(0)):
        got = module.score_documents(odd_docs, module.fit(odd_docs, labels))
        assert got.columns == [c for c in odd_docs.columns if c != "score"] + ["score"]
        rows = got.collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert module.score_documents(no_docs, module.fit(no_docs, said)).count() == 0


def test_isotonic_and_trees():
    at, value = gbt_toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and len(at) == 3
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert ((gbt_toxicity.boost(x, y).margins(x) > 0) == y).mean() > 0.98


def test_obfuscation_counts():
    marks = gbt_toxicity._Marks(gbt_toxicity.Lexicon())
    value = lambda text, name: gbt_toxicity.features(text, marks)[gbt_toxicity.NAMES.index(name)]
    assert value("you 1d1ot and st*pid l0ser", "obfuscated_hits") >= 1 and value("an i d i o t here", "spaced") > 0
    assert value("you are an idiot", "near_you") > 0 and value("an idiot sat by the far old river for you", "near_you") == 0


def test_mahalanobis_by_definition():
    rng = np.random.default_rng(1)
    raw = rng.random((300, len(qda_quality.NAMES)))
    y = (raw[:, 1] > 0.6).astype(int)
    m = qda_quality.train(raw, y)
    z = (qda_quality.transform(raw) - m.centre) / m.scale
    for c in (0, 1):
        inverse = m.factors[c] @ m.factors[c].T
        mine = (((z - m.means[c]) @ m.factors[c]) ** 2).sum(axis=1)
        assert np.allclose(mine, np.einsum("ij,jk,ik->i", z - m.means[c], inverse, z - m.means[c]))


def test_mixing(spark, odd_docs, no_docs):
    rows = queries.op9_mixing(spark, MEDIUM).toPandas()
    assert len(rows) == 1000 and (rows.rate >= 0).all() and (abs(rows.copies - rows.rate) < 1).all()
    p = rows[[f"p_{d}" for d in queries.MIX_WEIGHTS]].values
    assert np.allclose(p.sum(axis=1), 1)
    totals = (p * (rows.tokens * rows.rate).values[:, None]).sum(axis=0)
    assert np.allclose(totals / totals.sum(), list(queries.MIX_WEIGHTS.values()), atol=1e-4)
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, MEDIUM, "documents").collect()}
    assert all(t == len(texts[i].split()) for i, t in zip(rows.doc_id, rows.tokens))
    said = queries.label_domains(queries.table(spark, MEDIUM, "labels")).toPandas().merge(rows, on="doc_id")
    assert (said.domain_x == said.domain_y).mean() > 0.9
    few = spark.createDataFrame([(4, "a"), (6, "b"), (6, "b"), (None, "a"), (7, None)], "doc_id long, domain string")
    for labelled in (few, few.limit(0)):
        got = soft_mixing.document_rates(odd_docs, labelled, {"a": 1, "b": 2, "all": 1})
        assert got.count() == 10
        assert soft_mixing.mix(odd_docs, labelled, {"a": 1, "b": 2, "all": 1}).columns == odd_docs.columns
    assert soft_mixing.document_rates(no_docs, few, {"a": 1}).count() == 0 and soft_mixing.mix(no_docs, few, {"a": 1}).count() == 0


def test_rates_by_brute_force(spark):
    """Same totals as a dense projected solver reaches, with rates at zero where the target asks for it."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3], 60)
    rows = spark.createDataFrame([(int(t), [float(x) for x in a]) for t, a in zip(rng.integers(1, 50, 60), p)], "tokens long, p array<double>")
    fitted = soft_mixing.fit_rates(rows, 2, [0.98, 0.02])
    assert np.allclose(fitted.totals, fitted.targets, rtol=1e-3)
    rates = [r[0] for r in rows.select(fitted.rate()).collect()]
    assert min(rates) == 0


def test_search(spark):
    table = queries.table(spark, SMALL, "embeddings")
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table.collect()}
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    hits = 0
    rows = queries.op10_ann(spark, SMALL).collect()
    asked = ids[ids % 50 == 0]
    for q in asked:
        score = mih_search.cosines(x, vectors[q])
        score[ids == q] = -9
        want = ids[np.lexsort((ids, -score))[:5]]
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5] and all(s == score[ids == i][0] for _, i, s in got)
        hits += len({i for _, i, _ in got} & set(want.tolist()))
    assert hits / (5 * len(asked)) >= 0.9


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (50, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, []), (1, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = [(r.query_id, r.rank, r.vec_id) for r in mih_search.search(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 50)] and [g[2] for g in got if g[0] == 50] == [0, 1, 2]
    assert mih_search.search(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert mih_search.search(df.filter("vec_id = 0"), lambda i: i % 50 == 0).count() == 0


def test_pigeonhole_probes_lose_nothing():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 16))
    codes = mih_search.fit(x, bits=32)
    for radius in (0, 3, 5, 9, 14):
        codes.radius = radius
        block = mih_search.BlockIndex(codes, np.arange(400), x)
        for i in range(20):
            want = np.flatnonzero(np.bitwise_count(block.packed ^ block.packed[i]).sum(axis=1) <= radius)
            assert (block.within(block.packed[i]) == want).all()


def test_pipeline(spark):
    docs = queries.table(spark, MEDIUM, "documents")
    rows = corpus_pipeline.run(spark, MEDIUM).toPandas()
    assert rows.round_trip.all() and set(rows.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert set(rows.doc_id) <= set(first.values())
    assert all(len(b) == 4 * n for b, n in zip(rows.ids, rows.n_tokens))
    good = {r.doc_id for r in queries.table(spark, MEDIUM, "labels").filter("quality = 1 AND toxic = 0").collect()} & set(first.values())
    assert len(good & set(rows.doc_id)) > 0.93 * len(good)


def test_near_dedup_stage_by_brute_force(spark):
    """All pairs of the stage's own input, by sets of five words."""
    docs = corpus_pipeline.exact_dedup_stage(spark, queries.table(spark, MEDIUM, "documents"), MEDIUM)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, MEDIUM).select("doc_id").collect()}
    sets = {r.doc_id: set_join.shingle_set(r.text, 5) for r in docs.collect()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * large and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert kept == {find(i) for i in ids} and len(kept) < len(ids)


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        some, none = stage(spark, odd_docs, MEDIUM), stage(spark, no_docs, MEDIUM)
        assert none.count() == 0
        if name == "tokens":
            assert some.columns == none.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
            assert some.count() == 10 and all(r.round_trip for r in some.collect())
        else:
            assert some.columns == odd_docs.columns
    ids = lambda stage: sorted((r.doc_id for r in stage(spark, odd_docs, MEDIUM).select("doc_id").collect()), key=lambda x: x or 0)
    assert ids(corpus_pipeline.exact_dedup_stage) == [None, 1, 3, 6, 7, 8]  # null sorts first; null text and empty text are equal
    assert ids(corpus_pipeline.near_dedup) == [1, 4, 6, 7, 8]  # blank texts are like empty ones


def test_run_on_empty_tables(spark, tmp_path, docs, labels):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
