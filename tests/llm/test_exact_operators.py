"""Sharding, exact dedup, SimHash, components, URL filter, BPE: against brute force."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, exact_dedup, queries, set_join, sharding, simhash, url_filter
from graphloom.llm.components import connected_components
from tests.conftest import SMALL


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_sharding(spark, odd_docs, no_docs):
    got = sharding.shard_uniformly(odd_docs, 4)
    assert got.columns == [c for c in odd_docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = got.collect()
    assert len(rows) == 10 and Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == [2, 2, 3, 3] and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_uniformly(no_docs, 4).count() == 0
    assert sharding.shard_uniformly(odd_docs.limit(2), 8).count() == 2


def test_sharding_is_uniform(spark):
    ids = spark.range(0, 8, 1, 3)
    seen = Counter()
    for seed in range(40):
        seen.update((r["id"], r["shard"]) for r in sharding.shard_uniformly(ids, 2, seed=seed).collect())
    assert all(8 <= seen[i, s] <= 32 for i in range(8) for s in (0, 1))


def test_communication_matrix():
    rows, sizes = [7, 0, 13, 5], [9, 8, 8]
    many = np.array([sharding.communication_matrix(rows, sizes, s) for s in range(2000)])
    assert (many.sum(axis=2) == rows).all() and (many.sum(axis=1) == sizes).all()
    assert np.allclose(many.mean(axis=0), np.outer(rows, sizes) / 25, atol=0.15)
    rng = np.random.default_rng(1)
    big = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(500)]
    assert abs(np.mean(big) - 750) < 3 and 10 < np.std(big) < 18


def test_op1(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op1_sharding(spark, SMALL).collect():
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_exact_dedup(spark, odd_docs, no_docs):
    for keep, best in (("smallest", min), ("largest", max)):
        rows = exact_dedup.exact_duplicates(odd_docs, keep=keep, fan_in=2).collect()
        texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
        groups = defaultdict(list)
        for i, t in texts:
            groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
        assert Counter(r["text_sha256"] for r in rows) == Counter({k: len(v) for k, v in groups.items()})
        for key, ids in groups.items():
            own = [r for r in rows if r["text_sha256"] == key]
            want = best(ids, key=lambda i: (i is not None, i or 0))
            assert {(r["keep_id"], r["group_size"]) for r in own} == {(want, len(ids))} and sum(r["kept"] for r in own) == 1
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    left = exact_dedup.drop_exact_duplicates(odd_docs, keep="largest")
    assert left.columns == odd_docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5, 6, 7, 8]
    assert exact_dedup.drop_exact_duplicates(no_docs).count() == 0
    lower = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string"), normalise=F.lower)
    assert {r["keep_id"] for r in lower.collect()} == {1}


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_exact_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, want.fetchall()))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2060)]
    want = union_find(pairs, {x for p in pairs for x in p})
    for gather in (False, True):
        got = connected_components(spark.createDataFrame(pairs + [(None, 5), (7, None)], "u long, v long"), gather=gather)
        assert {r.node: r.component for r in got.collect()} == want
        assert connected_components(spark.createDataFrame([], "u long, v long"), gather=gather).count() == 0


def near(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("alpha beta gamma delta".split())
    return " ".join(words)


def family(spark):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(150)]
        texts += [near(words, rng, n) for n in (0, 0, 1, 1, 2, 3)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("distance, shingle", [(1, 3), (2, 3), (3, 2)])
def test_simhash(spark, distance, shingle):
    texts, df = family(spark)
    prints = [simhash.fingerprint(t, shingle) & (1 << 64) - 1 for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]
    want = union_find(pairs, range(len(texts)))
    got = simhash.near_duplicate_groups(df, shingle=shingle, max_distance=distance).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in want}


def test_simhash_links_lose_nothing(spark):
    """Random fingerprints around a few centres: every pair within the distance is found."""
    rng = random.Random(5)
    made = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            made.add(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(x,) for x in made], "_fp long")
    for d in (1, 2, 3):
        want = {(min(a, b), max(a, b)) for a in made for b in made if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= d}
        assert {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.links(df, d).collect()} == want


def test_fingerprint_by_definition():
    import xxhash

    text = "The  QUICK brown\tfox Ä b"
    words = ["the", "quick", "brown", "fox", "Ä", "b"]
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(4)]
    bits = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 2)
    assert simhash.fingerprint(text, 3) & (1 << 64) - 1 == bits
    assert simhash.fingerprint("A b", 3) & (1 << 64) - 1 == xxhash.xxh64(b"a b", seed=42).intdigest()
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == 0


def test_simhash_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicate_groups(odd_docs, shingle=3, max_distance=2).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5, None)} == {4}
    assert simhash.near_duplicate_groups(no_docs).count() == 0
    left = simhash.drop_near_duplicates(odd_docs, shingle=3, max_distance=2)
    assert left.columns == odd_docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 4, 6, 7, 8]


def test_similar_groups(spark, odd_docs, no_docs):
    texts, df = family(spark)
    sets = [set_join.shingle_set(t, 5) for t in texts]
    similar = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    strict = union_find([(i, j) for i in range(len(texts)) for j in range(i) if similar(i, j) >= 0.8], range(len(texts)))
    got = {r.doc_id: r.component_id for r in set_join.similar_groups(df).collect()}
    assert all(strict[i] == strict[got[i]] for i in got)
    assert sum(got[i] == strict[i] for i in got) >= 0.9 * len(got)
    rows = set_join.similar_groups(odd_docs).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in rows if r.doc_id in (4, 5, None)} == {4}
    assert set_join.similar_groups(no_docs).count() == 0


RULES = [("com", "/", "allow"), ("bad.org", "/", "block"), ("x.bad.org", "/ok", "allow"), ("net", "/es/", "block")]


def test_url_filter(spark):
    link = "<html><head><LINK href='{}' rel=canonical></head>"
    pages = [
        (1, "http://a.com/x", None),
        (2, "HTTPS://X.BAD.org/ok/1?q#f", ""),
        (3, "http://y.bad.org", "<p>"),
        (4, "http://y.bad.org/", "<p>"),
        (5, "http://alias.io/1", link.format("http://y.bad.org/")),
        (6, "http://alias.io/2", link.format("/1")),
        (7, "http://alias.io/3", '<meta http-equiv="refresh" content="0; url=http://alias.io/2">'),
        (8, "http://both.io/1", link.format("http://y.bad.org/z")),
        (9, "http://both.io/2?a=1", link.format("http://both.io/1") + '<meta http-equiv="refresh" content="5;URL=http://a.com/x">'),
        (10, None, None),
        (11, "no scheme", "<p>"),
        (12, "http://n.net/es/", None),
        (13, "http://alone.io/", "<p>"),
        (13, "http://alone.io/", "<p>"),
    ]
    df = spark.createDataFrame([p + ("r", "v") for p in pages], "page_id long, url string, html string, rule string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    assert {i: (r.rule, r.verdict, r.via) for i, r in got.items()} == {
        1: ("com/", "allow", "rule"),
        2: ("x.bad.org/ok", "allow", "rule"),
        3: (None, "allow", "default"),
        4: ("bad.org/", "block", "rule"),
        5: (None, "block", "alias"),
        6: (None, "block", "alias"),
        7: (None, "block", "alias"),
        8: (None, "allow", "alias"),
        9: (None, "allow", "alias"),
        10: (None, "allow", "default"),
        11: (None, "allow", "default"),
        12: ("net/es/", "block", "rule"),
        13: (None, "allow", "default"),
    }
    assert (got[2].host, got[2].path, got[3].path, got[10].host, got[11].path) == ("x.bad.org", "/ok/1", "", "", "")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    redirects = spark.createDataFrame([("http://alone.io/", "http://elsewhere.bad.org/")], "from_url string, to_url string")
    again = url_filter.judge_urls(df, rules, redirects=redirects).filter("page_id = 13").collect()
    assert [r.verdict for r in again] == ["block", "block"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


@pytest.fixture(scope="module")
def encoder():
    with open(queries.TOKENIZER) as file:
        return bpe.Encoder(file.read())


def same(encoder, library, text):
    ids = encoder.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want, text
    assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_against_library(encoder, library, docs):
    rng = random.Random(1)
    parts = ["a", "th", "ing", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "1", "é", "日本", "🙂", "\xa0", "\x1c", "\x85", "<|endoftext|>", "!!", "_", "ab" * 20, "²", "\r\n", "aaaa"]
    for _ in range(2000):
        same(encoder, library, "".join(rng.choice(parts) for _ in range(rng.randrange(20))))
    for _ in range(500):
        same(encoder, library, "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0x300), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(20))))
    for r in docs.collect():
        same(encoder, library, r.text or "")


def test_bpe_compatibility_by_definition(encoder, library):
    rng = random.Random(2)
    ids = [i for i, rank in enumerate(encoder.rank) if rank >= 0 and encoder.bytes_of[i].isalpha() and encoder.bytes_of[i].isascii()]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert encoder.compatible(a, b) == (library.encode((encoder.bytes_of[a] + encoder.bytes_of[b]).decode(), add_special_tokens=False).ids == [a, b])


def test_bpe_caches_start_anew(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    same(encoder, library, "one two three four five six seven eight nine ten eleven twelve " * 3)


def test_bpe_rows(spark, odd_docs, no_docs, library):
    got = bpe.encode_documents(odd_docs, queries.TOKENIZER)
    assert got.columns == [c for c in odd_docs.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    for r in got.collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    assert bpe.encode_documents(no_docs, queries.TOKENIZER).count() == 0
    checked = bpe.encode_documents(odd_docs, queries.TOKENIZER, keep=["doc_id"], check=True)
    assert checked.columns == ["doc_id", "ids", "round_trip"] and all(r.round_trip for r in checked.collect())


def test_bpe_needs_every_byte():
    with pytest.raises(ValueError, match="each byte"):
        bpe.Encoder(json.dumps({"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}))


def test_op7(spark, docs, library):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op7_bpe(spark, SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
