"""Spelling variants, b-bit MinHash and vector codes, against SQL, brute force and on odd rows."""

import hashlib
import random
from zlib import crc32

import duckdb
import numpy as np
import pytest

from graphloom.llm import bbit_minhash, code_books, queries as Q, set_join, spelling
from tests.conftest import SMALL


@pytest.mark.parametrize("name, source", [("op11_spelling", "documents"), ("op13_codes", "embeddings")])
def test_against_duckdb(spark, name, source):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {source} AS SELECT * FROM '{SMALL}/{source}.parquet'")
    want = con.execute(Q.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = Q.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    assert rows and rows == sorted(want.fetchall(), key=str)


# spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spelling_by_force(rows, every=199, min_length=6, min_count=5, factor=5):
    n = {}
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\u0080" else c
            elif run:
                h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] = n.get(run, 0) + 1
                run = ""
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    out = {}
    for w in n:
        around = [x for x in n if x != w and near(w, x)]
        best = min(around, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best is not None and n[best] >= factor * n[w] else None, len(around))
    rooted = {}
    for w, (form, around) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rooted[w] = (form, root, n[w], around, n.get(form))
    return rooted


def spelled(spark, rows, **given):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(df, **given).collect()}


def test_spelling_by_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abCéßÿ") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    rows = [(i, rng.choice([" ", "-", "\n", "1"]).join(rng.choices(words, [1 / (1 + j) ** 1.3 for j in range(len(words))], k=200))) for i in range(60)]
    want = spelling_by_force(rows, every=7, min_length=2, min_count=1, factor=2)
    assert any(v[1] != k and v[1] != v[0] for k, v in want.items())  # forms of forms
    assert spelled(spark, rows, every=7, min_length=2, min_count=1, factor=2) == want


def test_long_chain_of_forms_and_ties(spark):
    # "a" * k is near "a" * (k + 1), each five times as frequent; two forms are level
    rows = [(None, ("a" * (6 + k) + " ") * 5 ** (k + 1)) for k in range(5)] + [(1, "bbbbbb " * 5 + "bbbbbc " * 25 + "bbbbba " * 25)]
    assert spelled(spark, rows, every=10**10) == (want := spelling_by_force(rows, every=10**10))
    assert want["a" * 6][1] == "a" * 10 and want["bbbbbb"][0] == "bbbbba"


def test_spelling_of_odd_rows(spark, odd_docs, no_docs):
    got = spelling.spelling_groups(odd_docs, min_length=4, min_count=4, every=10**10)
    assert {r.word: r.n for r in got.collect()} == {"same": 4, "text": 4, "here": 4, "word": 40_000}
    assert spelling.spelling_groups(no_docs).collect() == []
    long = "x" * 3000
    rows = [(1, f"{long} " * 5 + f"{long}x " * 25)]
    assert spelled(spark, rows, every=10**10)[long] == (long + "x", long + "x", 5, 1, 25)


def test_keys_that_collide_are_verified(spark, monkeypatch):
    monkeypatch.setattr(spelling, "candidates", lambda words: words.alias("a").crossJoin(words.alias("b")).selectExpr("a._id AS u", "b._id AS v", "explode(array(0, 2)) AS role", "0 AS pos"))
    words = spark.createDataFrame([(0, "abcdef", 1), (1, "xbcdef", 1), (2, "bcdef", 1), (3, "zzzzzz", 1)], "_id long, word string, n long")
    found = {(r.u, r.v) for r in spelling.links(words).collect()}
    assert found == {("abcdef", "xbcdef"), ("xbcdef", "abcdef"), ("bcdef", "abcdef"), ("bcdef", "xbcdef")}


# MinHash


def minhash_by_force(rows, shingle, percent):
    sets = []
    for _, text in rows:
        words = set_join.words_of(text)
        sets.append(set_join.shingle_set(text, shingle) if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[y] = x
    return [(doc_id, len(s), rows[find(i)][0], doc_id == rows[find(i)][0]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def minhashed(spark, rows, **given):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(map(tuple, bbit_minhash.near_duplicates(df, **given).collect()))


def test_minhash_query_by_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, Q.op12_minhash(spark, SMALL).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert got == sorted(minhash_by_force(rows, 3, 85))


def test_minhash_of_families_around_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(rng.choice([7, 9, 60, 300]))]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words[: rng.choice([None, -1])])))
    got = minhashed(spark, rows, shingle=3, percent=85)
    assert got == sorted(minhash_by_force(rows, 3, 85))
    assert 6 < sum(kept for *_, kept in got) < len(rows) / 2


def test_minhash_bucket_of_several_components(spark):
    # near misses of one template, so that buckets hold many components; a few of them have a near copy
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**7)}"
    template = [word() for _ in range(400)]
    rows = []
    for i in range(300):
        words = template + [word() for _ in range(90)]
        rows.append((len(rows), " ".join(words)))
        if i % 9 == 0:
            words[20 * (i % 17)] = word()
            rows.append((len(rows), " ".join(words)))
    assert minhashed(spark, rows, shingle=3, percent=85) == sorted(minhash_by_force(rows, 3, 85))


def test_estimates_and_bands():
    rng = np.random.default_rng(4)
    errors, met = [], 0
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = np.concatenate([a[:184], rng.integers(0, 1 << 63, 16, dtype=np.uint64)])
        true = 184 / 216
        x, y = bbit_minhash.minima(a), bbit_minhash.minima(b)
        planes = [np.unpackbits(bbit_minhash.packed_bits(v).view(np.uint8).reshape(bbit_minhash.BITS, -1), axis=1) for v in (x, y)]
        matches = bbit_minhash.HASHES - int((planes[0] ^ planes[1]).any(axis=0).sum())
        chance = 2.0**-bbit_minhash.BITS
        errors.append((matches / bbit_minhash.HASHES - chance) / (1 - chance) - true)
        met += bool(set(bbit_minhash.band_keys(x).tolist()) & set(bbit_minhash.band_keys(y).tolist()))
    assert met == 300
    assert abs(np.mean(errors)) < 0.01 and np.min(errors) > bbit_minhash.least_estimate(true) - true
    share = true + (1 - true) * chance
    assert np.std(errors) == pytest.approx((share * (1 - share) / bbit_minhash.HASHES) ** 0.5 / (1 - chance), rel=0.25)


def test_minhash_of_odd_rows(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in bbit_minhash.near_duplicates(odd_docs, shingle=3, percent=85).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, 4, False), (6, 2, 6, True)} <= got
    assert bbit_minhash.near_duplicates(odd_docs).count() == odd_docs.count()
    assert bbit_minhash.near_duplicates(no_docs).collect() == []
    only = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in bbit_minhash.near_duplicates(only, shingle=3).collect()] == [(None, 2, None, False)] * 2 + [(None, 0, None, False)]


# vector codes


def test_partial_distances_by_force():
    rng = np.random.default_rng(1)
    for dimension, spread in ((1, 3), (2, 4), (5, 9), (16, 500), (16, 1 << 24)):
        rows = rng.integers(-spread, spread, (700, dimension))
        book = rng.integers(-spread, spread, (256, dimension)) // np.arange(1, dimension + 1)
        order = code_books.search_order(book)
        assert (np.diff(book.var(axis=0)[order]) <= 1e-6 * book.var()).all()
        found, distance, terms = code_books.nearest(rows, book, order)
        every = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert terms <= every.size * dimension and (dimension < 16 or terms < 0.8 * every.size * dimension)


def codes_by_force(rows, parts, entries, rounds):
    vectors = np.array([r[1] for r in rows], dtype=np.int64)
    cut = np.array_split(np.arange(vectors.shape[1]), parts)
    books = [vectors[:entries, c].copy() for c in cut]
    for last in [False] * rounds + [True]:
        far = [((vectors[:, c][:, None] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books)]
        codes = [x.argmin(axis=1) for x in far]
        if not last:
            for c, b, code in zip(cut, books, codes):
                for e in set(code.tolist()):
                    b[e] = vectors[code == e][:, c].sum(axis=0) // (code == e).sum()
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(rows))], sum(x.min(axis=1) for x in far).tolist(), digest


def test_codes_by_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=10)], int(rng.integers(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = sorted(code_books.compress(df, parts=4, entries=32, rounds=3).collect())
    floats = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    codes, errors, digest = codes_by_force(list(enumerate(np.floor(floats * 1024).astype(np.int64).tolist())), 4, 32, 3)
    sums = {k: sum(e for e, r in zip(errors, rows) if r[2] == k) for k in range(3)}
    assert [tuple(r) for r in got] == [(i, c, e, sums[r[2]], digest) for i, (c, e, r) in enumerate(zip(codes, errors, rows))]


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, [1.0, 2.0, 3.0, 4.0], None, 1),
        (1, [0.0, 0.0, 0.0, 0.0], 7, 2),
        (1, [0.0, 0.0, 0.0, 0.0], 7, 2),
        (2, None, 7, 3),
        (4, [1.0, None, 1.0, 1.0], 7, 4),
        (5, [1.0, nan, 1.0, 1.0], 7, 4),
        (6, [inf, 1.0, 1.0, 1.0], 7, 4),
        (7, [1.0, 1.0], 7, 4),
        (None, [-1e30, 1e30, 0.5, -0.0001], None, 5),
        (8, [], 7, 5),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code int")
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in code_books.compress(df).collect()}
    # as many entries as rows; equal parts go to the lower one
    assert got == {(1, "00000000", 0, 0), (3, "02020202", 0, 0), (None, "03030303", 0, 0)}
    # one entry, the first row's, which becomes the floored mean
    one = {(r.vec_id, r.code): (r.error, r.label_error) for r in code_books.compress(df.filter("vec_id IN (1, 3)"), entries=1).collect()}
    mean = [1024 * i // 3 for i in (1, 2, 3, 4)]
    first, last = sum(x * x for x in mean), sum((1024 * i - x) ** 2 for i, x in zip((1, 2, 3, 4), mean))
    assert one == {(1, "00000000"): (first, 2 * first), (3, "00000000"): (last, last)}
    assert code_books.compress(df.limit(0)).collect() == []
    assert code_books.compress(df.filter("vec_id = 8")).count() == 1  # a vector without components
