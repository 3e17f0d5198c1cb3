import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, set_join
from graphloom.llm.simhash import signature


def groups_by_force(texts):
    sets = [set_join.shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def groups(spark, texts, **given):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r.component_id for r in set_join.similar_groups(df, **given).collect()}


def template_family(rng):
    """Many texts that share a template at about 0.6, some of them with a near-duplicate."""
    word = lambda: f"w{rng.randrange(10**6)}"
    template = [word() for _ in range(300)]
    texts = []
    for i in range(400):
        own = [word() for _ in range(90)]
        texts.append(template + own)
        if i % 10 == 0:
            near = template + own
            for at in range(5, 390, 52):
                near[at] = word()
            texts.append(near)
    return [" ".join(t) for t in texts]


def chain_family(rng):
    """Texts of similarities all around the threshold."""
    base = [f"b{i}" for i in range(200)]
    texts = []
    for _ in range(80):
        t = list(base)
        for _ in range(rng.randrange(8)):
            t[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    return texts


def thousand_copies(rng):
    """Over a thousand near copies of one text, most of them at 0.8 or more to others, some below it to all."""
    base = [f"c{i}" for i in range(120)]
    texts = []
    for i in range(1100):
        t = list(base)
        for _ in range(1 + i % 4):
            t[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("make", [template_family, chain_family, thousand_copies])
def test_crowded_buckets(spark, make):
    texts = make(random.Random(5))
    want = groups_by_force(texts)
    assert len(set(want.values())) < len(texts)
    assert groups(spark, texts) == want


def test_crowded_blocks(spark, monkeypatch):
    """Small blocks, and components in rounds as of many links."""
    monkeypatch.setattr(components, "IN_ONE_TASK", 0)
    monkeypatch.setattr(set_join, "BLOCK", 4)
    texts = chain_family(random.Random(6))
    assert groups(spark, texts) == groups_by_force(texts)


def test_counting_in_pieces(spark, monkeypatch):
    """Groups of shingles to count that are cut smaller change nothing."""
    texts = template_family(random.Random(9))[:150]
    source = spark.createDataFrame([(t,) for t in texts], "_text string")
    whole = set_join.rarity(source, 5, 1)
    monkeypatch.setattr(set_join, "GROUP", 2)
    assert set_join.cut_log_for(50_000) == 6 and set_join.cut_log_for(1 << 50) == 11
    pieces = set_join.rarity(source, 5, 50_000)
    assert (whole.map == pieces.map).all()
    frequent = dict(zip(whole.keys.tolist(), whole.counts.tolist()))
    assert set(pieces.keys.tolist()) <= set(frequent) and all(frequent[k] == n for k, n in zip(pieces.keys.tolist(), pieces.counts.tolist()))
    assert groups(spark, texts) == groups_by_force(texts)


def threshold_pairs(rng):
    """Pairs alone in the corpus at a similarity of just 0.8, or just below it."""
    texts = []
    for i in range(300):
        words = [f"p{rng.randrange(10**7)}" for _ in range(94 if i % 3 else 93)]
        near = list(words)
        for at in (20, 60):
            near[at] = f"q{rng.randrange(10**7)}"
        texts += [" ".join(words), " ".join(near)]
    return texts


def test_pairs_at_the_threshold(spark):
    texts = threshold_pairs(random.Random(8))
    want = groups_by_force(texts)
    assert len(set(want.values())) == 400
    assert groups(spark, texts) == want


def repeated_lines(rng):
    """Unlike texts under one run of a word; near-duplicates of which one repeats a line many times."""
    run = lambda k: " ".join(f"r{rng.randrange(10**6)}" for _ in range(k))
    alike = ["again " * 500 + run(60) for _ in range(6)]
    base = run(200)
    line = " ".join(base.split()[20:32])
    return [*alike, base, base + (" " + line) * 60, run(100)]


def test_repeats_do_not_count(spark):
    texts = repeated_lines(random.Random(7))
    want = groups_by_force(texts)
    assert want[7] == 6 and len(set(want.values())) == len(texts) - 1
    assert groups(spark, texts) == want


def test_fingerprints_never_lose_a_pair(spark):
    """Pairs of all similarities: the filter keeps each one at the threshold or above, and drops most below."""
    rng = random.Random(10)
    rows, alike = [], {}
    for i in range(3000):
        n = rng.choice([1, 2, 7, 30, 150, 700])
        base = [rng.randrange(1 << 63) for _ in range(n)]
        other = [x if rng.random() > rng.random() / 4 else rng.randrange(1 << 63) for x in base] + [rng.randrange(1 << 63) for _ in range(rng.randrange(1 + n // 6))]
        a, b = set(base), set(other)
        alike[i] = len(a & b) / len(a | b)
        prints = [set_join.fingerprint(np.array(sorted(x), dtype=np.uint64)).tolist() for x in (a, b)]
        assert sum((x ^ y).bit_count() for x, y in zip(*[np.array(p).astype(np.uint64).tolist() for p in prints])) <= len(a ^ b)
        rows.append((i, *prints, len(a), len(b)))
    df = spark.createDataFrame(rows, "i int, _fu array<long>, _fv array<long>, _su int, _sv int")
    kept = {r.i for r in df.filter(set_join._near(0.8)).collect()}
    assert {i for i, s in alike.items() if s >= 0.8} <= kept
    far = [i for i, s in alike.items() if s < 0.7]
    assert len(far) > 300 and len(kept & set(far)) < 0.1 * len(far)


def test_simhash_names_pairs(spark):
    """Pairs of near and of equal fingerprints; unlike texts of one fingerprint are a pair that verification drops."""
    base = [f"w{i}" for i in range(400)]
    mostly = ["same"] * 300
    texts = [" ".join(base), " ".join([*base[:-1], "end"]), " ".join([*mostly, *base[:50]]), " ".join([*mostly, *base[100:150]]), " ".join(["other"] * 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = docs.select(F.col("doc_id").alias("_n"), signature(F.col("text")).alias("_sig"))
    pairs = {(min(r), max(r)) for r in set_join.simhash_pairs(docs, nodes, shingle=5, max_distance=3).collect()}
    assert pairs == {(0, 1), (2, 3)}
    found = {r._id: r._component for r in set_join.members(docs, shingle=5, similarity=0.8, max_distance=3).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_near_dedup_goes_through_simhash(spark, monkeypatch):
    import corpus_pipeline

    seen = []
    monkeypatch.setattr(set_join, "linked", lambda fps, d, real=set_join.linked: seen.append(d) or real(fps, d))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 2 and seen == [corpus_pipeline.MAX_DISTANCE]
