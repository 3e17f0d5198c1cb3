"""The registered query of each operator, on its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import bbit_minhash, bpe, code_books, ecoc_langid, exact_dedup, gbt_toxicity, mih_search, qda_quality, sharding, simhash, soft_mixing, spelling, url_filter


#: The vocabulary file.
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform shuffle into 8 shards whose row counts are at most one apart."""
    placed = sharding.shard_uniformly(table(spark, sf_dir, "documents"), 8)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: Host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's verdict, by rule or through its redirects and canonical links."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).drop("via")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of equal texts and the row of it that stays."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's SimHash fingerprint and near-duplicate group."""
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)


def _remainder(parts: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score, learnt from the labels of two thirds of the documents."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(_remainder(3) != 1)
    found = qda_quality.score_documents(docs, qda_quality.fit(docs, labels), keep=["doc_id"])
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learnt from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents")
    model = ecoc_langid.fit(docs.filter(_remainder(4) != 2))
    return ecoc_langid.identify(docs, model, keep=["doc_id"]).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's BPE ids and of the text they decode to."""
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER, keep=["doc_id"])
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity score, learnt from the labels of three quarters of the documents."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(_remainder(4) != 2)
    found = gbt_toxicity.score_documents(docs, gbt_toxicity.fit(docs, labels), keep=["doc_id"])
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Domains of the labels table and their shares of the mixed tokens.
MIX_WEIGHTS = {"clean": 0.9, "junk": 0.05, "toxic": 0.05}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain); no domain where a label that would decide it is null or neither 0 nor 1."""
    domain = F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 0), "junk").when((F.col("toxic") == 0) & (F.col("quality") == 1), "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's domain posterior, and the rate that brings the domains' tokens to MIX_WEIGHTS."""
    labels = label_domains(table(spark, sf_dir, "labels"))
    found = soft_mixing.document_rates(table(spark, sf_dir, "documents"), labels, MIX_WEIGHTS)
    return found.select("doc_id", "tokens", "domain", *[F.coalesce(F.col("posterior")[d], F.lit(0.0)).alias(f"p_{d}") for d in MIX_WEIGHTS], "rate", "copies")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each vector whose vec_id is divisible by 50."""
    return mih_search.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frequent word's more frequent variant, and where such variants lead."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), every=199, min_length=6, min_count=5, factor=5)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of texts with similar sets of three-word shingles."""
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's code of four bytes, and its error."""
    return code_books.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_url_filter": op2_url_filter,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_langid": op6_langid,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_ann": op10_ann,
    "op11_spelling": op11_spelling,
    "op12_minhash": op12_minhash,
    "op13_codes": op13_codes,
}

# Pages link here by canonical links and refresh redirects with full urls; the
# recursion spreads the least verdict (allow before block) of a url's class.
_OP2_SQL = r"""
WITH RECURSIVE
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*(\?[^#]*)?', 1), '') AS query,
         regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]*)', 1) AS target
  FROM pages),
m AS (
  SELECT DISTINCT host, path,
         arg_max(rhost || rpath, length(rhost || rpath)) OVER (PARTITION BY host, path) AS rule,
         arg_max(rverdict, length(rhost || rpath)) OVER (PARTITION BY host, path) AS rverdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)),
links AS (
  SELECT host || path || query AS a, regexp_replace(regexp_replace(target, '^[^:]*://', ''), '#.*', '') AS b
  FROM p WHERE contains(target, '://')),
reach(a, b) AS (
  SELECT host || path || query, host || path || query FROM p
  UNION
  SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a),
spread AS (
  SELECT r.a, min(m.rverdict) AS verdict
  FROM reach r JOIN p ON r.b = p.host || p.path || p.query JOIN m ON m.host = p.host AND m.path = p.path
  WHERE r.a IN (SELECT a FROM links UNION SELECT b FROM links) GROUP BY r.a)
SELECT page_id, p.host, p.path, m.rule, coalesce(m.rverdict, s.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.host = p.host AND m.path = p.path LEFT JOIN spread s ON s.a = p.host || p.path || p.query"""

# CRC-32 by a table of bytes; near words are found by their common deletions
_OP11_SQL = """
WITH RECURSIVE
crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS x FROM found GROUP BY doc, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS h
  FROM counted, crc),
w AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cuts AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT a.word AS u, b.word AS v FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, cuts.word FROM w JOIN cuts ON w.word = rest
  UNION SELECT cuts.word, w.word FROM w JOIN cuts ON w.word = rest),
best AS (SELECT u, count(*) AS n_near, arg_min(v, (-n, encode(v))) AS v, max(n) AS vn FROM near JOIN w ON word = v GROUP BY u),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN vn >= 5 * n THEN v END AS form, CASE WHEN vn >= 5 * n THEN vn END AS form_n FROM w LEFT JOIN best ON word = u),
chain(word, last) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms g ON g.word = c.last WHERE g.form IS NULL"""


def _op13_sql(rounds: int = 4) -> str:
    """Assignment and averaging ``rounds`` times, and once more the assignment; sums of doubles are exact at these sizes."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, len(embedding) // 4 AS d
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT vec_id, p, v[p * d + 1 : (p + 1) * d] AS v FROM kept, range(4) r(p))",
        "book0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256)",
    ]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT vec_id, p, min_by(e, (far, e)) AS e, min(far) AS far
  FROM (SELECT vec_id, t.p, e, list_inner_product(t.v, t.v) - 2 * list_inner_product(t.v, b.v) + list_inner_product(b.v, b.v) AS far FROM parts t JOIN book{i} b ON b.p = t.p)
  GROUP BY vec_id, p)""")
        if i < rounds:
            steps.append(f"""book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
    SELECT p, e, list(x ORDER BY pos) AS v FROM (
      SELECT n.p, n.e, pos, floor(sum(t.v[pos]) / count(*)) AS x FROM near{i} n JOIN parts t ON t.vec_id = n.vec_id AND t.p = n.p, unnest(range(1, len(t.v) + 1)) r(pos) GROUP BY n.p, n.e, pos)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id"""


ORACLE_SQL = {
    "op2_url_filter": _OP2_SQL,
    "op3_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op11_spelling": _OP11_SQL,
    "op13_codes": _op13_sql(),
}
