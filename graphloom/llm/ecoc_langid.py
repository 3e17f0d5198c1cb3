"""Language ID by error-correcting output codes.

Each language has a codeword of bits. One binary classifier for each bit, a
logistic regression over hashed character 1- to 4-gram frequencies, predicts
that bit; the languages' losses, summed over the bits with the classifiers'
weights, decide (loss-weighted decoding), and a small gap between the two best
marks a text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.ship import ship
from graphloom.llm.rows import with_text_results

DIMENSIONS = 1 << 12
UNKNOWN = "und"
_BLOCK = 1 << 18
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in each process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def ngram_counts(text: str) -> np.ndarray | None:
    """Hashed counts of the 1- to 4-grams of letters and single gaps; None without a letter. Works in blocks."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    table, any_letter = _letters(), False
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for at in range(0, len(codes), _BLOCK):
        block = codes[max(0, at - 3) : at + _BLOCK]
        letter = table[block]
        any_letter |= bool(letter[min(at, 3) :].any())
        c = np.where(letter, block, 0)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        c = c[keep]  # runs of other characters shrink to one gap
        hashed = c * _MIX[0]
        counts += np.bincount(hashed >> shift, minlength=DIMENSIONS)
        for n in range(1, min(4, len(c))):
            hashed = hashed[:-1] * _MIX[1] + c[n:] * _MIX[n]
            counts += np.bincount((hashed ^ (hashed >> np.uint32(15))) * _MIX[2] >> shift, minlength=DIMENSIONS)
    return counts if any_letter else None


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of the frequencies: a vector of length 1."""
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of -1 and 1 that differ in as many places as can be: all 2**(k-1) - 1 splits up to 6 languages, else random ones."""
    if k <= 1:
        return np.ones((k, 1), dtype=np.int8)
    if k <= 6:
        splits = [[1, *(1 if s >> i & 1 else -1 for i in range(k - 1))] for s in range(2 ** (k - 1) - 1)]
        return np.array(splits, dtype=np.int8).T
    rng, bits = np.random.default_rng(seed), 8 + int(12 * np.log2(k))

    def distance(m: np.ndarray) -> int:
        m = m.astype(np.float32)
        return int((bits - (m @ m.T - 2 * bits * np.eye(k)).max()) // 2)

    usable = lambda m: bool((np.abs(m.sum(axis=0, dtype=np.int64)) < k).all())
    # random rows differ in about half of the bits; fewer are tried the more there are
    made = [m for m in (rng.choice(np.array([-1, 1], dtype=np.int8), (k, bits)) for _ in range(max(4, min(200, 20_000 // k)))) if usable(m)]
    return max(made, key=distance)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        return (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(axis=2)

    def predict(self, texts: list[str | None], ambiguous_gap: float) -> list[tuple[str, float, bool]]:
        out = []
        for text in texts:
            counts = ngram_counts(text) if text else None
            if counts is None or not self.languages:
                out.append((UNKNOWN, 0.0, True))
                continue
            loss = self.losses(features(counts)[None])[0]
            p = np.exp(loss.min() - loss)
            p /= p.sum()
            first, *rest = np.argsort(loss, kind="stable")
            gap = loss[rest[0]] - loss[first] if rest else np.inf
            out.append((self.languages[first], float(p[first]), bool(gap < ambiguous_gap)))
        return out


def train(x: np.ndarray, y: np.ndarray, languages: list[str], *, rounds: int = 300, decay: float = 1e-5, enough: float = 0.02) -> Model:
    """Full-batch logistic regressions, one for each bit, by accelerated gradient steps, until the gradient has shrunk to ``enough`` of its first length."""
    code = codewords(len(languages))
    target = code[y].astype(np.float32)
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / (len(languages) * np.maximum(share, 1)))[y].astype(np.float32)[:, None] / len(y)
    w = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32)
    b = np.zeros(code.shape[1], dtype=np.float32)
    look_w, look_b, rate = w, b, 2.0  # rows have length 1, so the curvature is 1/2 at most
    first = None
    for t in range(rounds):
        pull = -target / (1 + np.exp(np.clip(target * (x @ look_w + look_b), -30, 30))) * weight
        slope = x.T @ pull + decay * look_w
        length = float(np.linalg.norm(slope))
        first = first or length
        new_w, new_b = look_w - rate * slope, look_b - rate * pull.sum(axis=0)
        look_w, look_b = new_w + t / (t + 3) * (new_w - w), new_b + t / (t + 3) * (new_b - b)
        w, b = new_w, new_b
        if length <= enough * first:
            break
    right = ((x @ w + b) * target > 0).mean(axis=0)
    return Model(languages, code, w, b, np.maximum(right - 0.5, 0.01).astype(np.float32) * 2)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000, total: int = 8000) -> Model:
    """A model learnt from ``docs`` with a language, about ``per_language`` of each and ``total`` in all at most.

    Rows are chosen by the hash of identifier and text, and rows of equal hash
    count once, so that neither a null nor a repeated identifier brings more.
    Only hashed counts, of DIMENSIONS numbers whatever the text's length, reach
    the driver: 8 KB a row. All languages are learnt; none, from an empty
    table, gives a model that answers ``und`` always.
    """
    spark = ship(docs.sparkSession)
    labelled = docs.select(F.xxhash64(F.lit(3), F.col(id_col), F.col(text_col).cast("string")).alias("_hash"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).alias("_lang")).filter("_lang IS NOT NULL AND _text IS NOT NULL")
    sizes = labelled.groupBy("_lang").agg(F.approx_count_distinct("_hash", 0.02).alias("count")).orderBy("_lang").collect()
    if not sizes:
        return Model([], np.zeros((0, 1)), np.zeros((DIMENSIONS, 1)), np.zeros(1), np.zeros(1))
    each = max(1, min(per_language, total // len(sizes)))
    shares = spark.createDataFrame([(r["_lang"], min(1.0, each / r["count"])) for r in sizes], "_lang string, _share double")
    chosen = labelled.join(F.broadcast(shares), "_lang").filter(F.pmod("_hash", F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    chosen = chosen.groupBy("_lang", "_hash").agg(F.min("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [n if t.is_valid and (n := ngram_counts(t.as_py())) is not None else None for t in batch.column(2)]
                vectors = pa.array([None if n is None else features(n).astype("<f2").tobytes() for n in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], ["lang", "hash", "x"]).filter(pc.is_valid(vectors))

    got = chosen.select("_lang", "_hash", "_text").mapInArrow(run, "lang string, hash long, x binary").toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((DIMENSIONS, 1)), np.zeros(1), np.zeros(1))
    place = {lang: i for i, lang in enumerate(languages)}
    y = np.array([place[x] for x in got.column("lang").to_pylist()])
    order = np.lexsort((got.column("hash").to_numpy(), y))  # one model, whatever the order of arrival
    x = np.empty((len(y), DIMENSIONS), dtype=np.float32)
    vectors = got.column("x")
    for to, at in enumerate(order):
        x[to] = np.frombuffer(vectors[int(at)].as_buffer(), dtype="<f2")
    return train(x, y[order], languages)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", ambiguous_gap: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    A text that is null or has no letter gets ``und``, score 0 and ambiguous.
    ``ambiguous`` also marks texts whose two best languages are closer than
    ``ambiguous_gap`` in loss. Whole texts are read, in blocks. Columns of the
    three names in the input are replaced, all others stay. Repeated rows give
    equal results; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[list]:
        return [list(x) for x in zip(*shared.value.predict(texts, ambiguous_gap))]

    results = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "ambiguous": ("boolean", pa.bool_())}
    return with_text_results(docs, text_col, results, run, keep)
