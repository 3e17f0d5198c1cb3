"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of lexicon words, their nearness to a second-person
pronoun, capitals, punctuation and obfuscation. The lexicon has a fixed seed
of insults and grows by words and word beginnings that the labelled documents
show far more often in toxic texts. Trees are grown on feature histograms and
boosted on the logistic loss; scores of held-back folds give the isotonic
curve that turns margins into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.ship import ship
from graphloom.llm.rows import AT_ONCE, with_text_results
from graphloom.llm.staging import Staged
from graphloom.llm.text_stats import labelled_sample

#: A small seed of common insults; the rest is learnt.
SEED_WORDS = frozenset("idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown fool freak creep jerk imbecile degenerate vermin filth garbage".split())
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
_WORD = re.compile(r"[^\W_]+")
_ODD_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[@$!*0134578|_.-]+[^\W\d_]+)+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W_])")
_LEET = str.maketrans("@$!013457|", "asioleastl")
_INNER = re.compile(r"[ *_.-]+")
_CAPITALS = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-Þ]{3,}(?![^\W_])")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MAY_BE_ODD = re.compile(r"[^\W\d_][@$!*0134578|_.-]+[^\W\d_]")
STEMS = (4, 5, 6, 7, 8)
NEAR = 5
NAMES = ["seed_hits", "seed_density", "word_hits", "word_density", "stem_hits", "stem_density", "distinct_hits", "near_you", "you_density", "upper", "capital_words", "exclaims", "questions", "obfuscated", "obfuscated_hits", "spaced", "log_words"]


@dataclass(frozen=True)
class Lexicon:
    words: frozenset = frozenset()
    stems: frozenset = frozenset()


class _Marks(dict):
    """For a lower-case word, one byte of marks; made on demand and kept for some hundred thousand words."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        stem = any(word[:n] in self.lexicon.stems for n in STEMS)
        mark = (word in SEED_WORDS) | (word in self.lexicon.words) << 1 | stem << 2 | (word in SECOND_PERSON) << 3 | (len(word) == 1) << 4
        if len(self) >= 300_000:
            self.clear()
        self[word] = mark
        return mark


_SEED, _KNOWN, _STEM, _YOU, _SINGLE = 1, 2, 4, 8, 16


def features(text: str | None, marks: _Marks) -> list[float]:
    """The dense features, over the whole text; a text without words has no hits and no densities."""
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    mark = np.frombuffer(bytes(map(marks.__getitem__, words)), dtype=np.uint8)
    n, k = max(1, len(text)), max(1, len(words))
    count = lambda bit: int(np.count_nonzero(mark & bit))
    seeds, known, stems, you = (count(b) for b in (_SEED, _KNOWN, _STEM, _YOU))
    hits = np.flatnonzero(mark & (_SEED | _KNOWN | _STEM))
    if you and len(hits):
        before = np.concatenate([[0], np.cumsum(mark & _YOU > 0)])
        near = int(np.count_nonzero(before[np.minimum(hits + NEAR + 1, len(words))] > before[np.maximum(hits - NEAR, 0)]))
    else:
        near = 0
    odd = _ODD_WORD.findall(lower) if _MAY_BE_ODD.search(lower) else []
    single = mark & _SINGLE > 0
    spaced = _SPACED.findall(lower) if len(single) > 3 and (single[3:] & single[2:-1] & single[1:-2] & single[:-3]).any() else []
    opened = [_INNER.sub("", x).translate(_LEET) for x in odd] + [_INNER.sub("", x) for x in spaced]
    return [
        min(seeds, 20),
        seeds / k,
        min(known, 20),
        known / k,
        min(stems, 20),
        stems / k,
        min(len({words[i] for i in hits}), 20),
        near / k,
        you / k,
        len(_UPPER.findall(text)) / n,
        len(_CAPITALS.findall(text)) / k,
        text.count("!") / k,
        text.count("?") / k,
        len(odd) / k,
        min(sum(marks[x] & (_SEED | _KNOWN | _STEM) > 0 for x in opened), 20),
        len(spaced) / k,
        np.log1p(len(words)),
    ]


def learn_lexicon(sample: DataFrame, *, least: int = 4, odds: float = 3.0, most: int = 4000) -> Lexicon:
    """Words and word beginnings that at least ``least`` toxic texts have, and toxic texts exp(odds) times as often.

    Counted over all texts of ``sample`` (_text, _label), as numbers of texts;
    at most the ``most`` of highest odds are kept.
    """
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                counts: dict[tuple[str, int], list[int]] = {}
                for label, text in zip(*(c.to_pylist() for c in whole.slice(at, AT_ONCE).columns)):
                    words = {w for w in set(_WORD.findall((text or "").lower())) if len(w) <= 40}
                    for term in [*((w, 0) for w in words), *{(w[:n], n) for w in words for n in STEMS if len(w) > n}]:
                        counts.setdefault(term, [0, 0])[label] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in counts], pa.string()), pa.array([n for _, n in counts], pa.int32()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
                    ["term", "stem", "clean", "toxic"],
                )

    sizes = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    clean, toxic = sizes.get(0, 0) + 1, sizes.get(1, 0) + 1
    counts = sample.select("_label", "_text").mapInArrow(run, "term string, stem int, clean long, toxic long")
    ratio = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("clean") + 0.5) / clean)
    totals = counts.groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = totals.filter(F.col("toxic") >= least).withColumn("odds", ratio).filter(F.col("odds") >= odds).orderBy(F.desc("odds"), "term", "stem").limit(most).collect()
    return Lexicon(frozenset(r["term"] for r in kept if not r["stem"]), frozenset(r["term"] for r in kept if r["stem"]))


@dataclass
class Trees:
    """Trees of equal depth: arrays of the inner nodes' features and thresholds and of the leaves' values."""

    depth: int
    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on histograms of at most ``bins`` bins for each feature."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(depth, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    d = x.shape[1]
    edges = []
    for j in range(d):
        values = np.unique(x[:, j])
        middles = (values[1:] + values[:-1]) / 2
        edges.append(middles if len(middles) < bins else np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])))
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    flat = binned + np.arange(d) * width
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            for v in range(2**level - 1, 2 ** (level + 1) - 1):
                inside = node == v
                if inside.any():
                    bin_of = flat[inside].ravel()
                    hg = np.bincount(bin_of, np.repeat(g[inside], d), d * width).reshape(d, width).cumsum(axis=1)
                    hh = np.bincount(bin_of, np.repeat(h[inside], d), d * width).reshape(d, width).cumsum(axis=1)
                    all_g, all_h = hg[:, -1:], hh[:, -1:]
                    gain = hg**2 / (hh + penalty) + (all_g - hg) ** 2 / (all_h - hh + penalty) - all_g**2 / (all_h + penalty)
                    gain[(hh < least) | (all_h - hh < least)] = -1
                    j, b = divmod(int(gain.argmax()), width)
                    if gain[j, b] > 1e-9 and b < len(edges[j]):
                        feature[v], cut[v] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf_of = node - (2**depth - 1)
        leaf = -rate * np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + penalty)
        margin += leaf[leaf_of]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(leaf)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step curve closest to ``y`` over ``margin``, by pooling adjacent violators: block middles and values."""
    order = np.lexsort((-y, margin))  # equal margins violate the order, so that they are pooled
    blocks: list[list[float]] = []  # sum of y, number, sum of margins
    for m, value in zip(margin[order], y[order]):
        blocks.append([float(value), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    at = np.array([b[2] / b[1] for b in blocks])
    # a block of n labels never says more than one of n + 1 could
    value = np.array([np.clip(b[0] / b[1], 0.5 / (b[1] + 1), 1 - 0.5 / (b[1] + 1)) for b in blocks])
    return at, np.maximum.accumulate(value)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    value: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not hasattr(self, "_marks"):
            self._marks = _Marks(self.lexicon)
        x = np.array([features(t, self._marks) for t in texts], dtype=np.float64).reshape(len(texts), len(NAMES))
        return np.interp(self.trees.margins(x), self.at, self.value)


def train(x: np.ndarray, y: np.ndarray, lexicon: Lexicon, folds: int = 5) -> Model:
    fold = np.arange(len(y)) % folds
    margin = np.zeros(len(y))
    for f in range(folds):
        if (fold == f).any():
            margin[fold == f] = boost(x[fold != f], y[fold != f]).margins(x[fold == f])
    at, value = isotonic(margin, y) if len(y) else (np.zeros(1), np.full(1, 0.5))
    return Model(lexicon, boost(x, y), at, value)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = 30_000) -> Model:
    """A model from about ``bound`` labelled documents at most.

    The trees are grown on features by a lexicon learnt from the other half of
    the documents, so that they see how well it does on texts it was not made
    from; the model's lexicon is then learnt from all. Only features and the
    lexicon's terms reach the driver. Without labels all scores are 0.5.
    """
    sample = Staged(labelled_sample(docs, labels, label_col, bound, id_col=id_col, text_col=text_col).withColumn("_half", F.pmod(F.xxhash64(F.lit(29), "_id"), F.lit(2))), "labelled")
    others = [learn_lexicon(sample.df.filter(F.col("_half") != half)) for half in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [_Marks(x) for x in shared.value]
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                x = [features(t.as_py(), marks[h.as_py()]) for h, t in zip(batch.column(0), batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    got = sample.df.select("_half", "_label", "_text").mapInArrow(run, "label int, x array<double>").collect()
    got = sorted((list(r["x"]), r["label"]) for r in got)
    # shuffled by a fixed seed: folds must not follow the features' order
    got = [got[i] for i in np.random.default_rng(7).permutation(len(got))]
    x = np.array([a for a, _ in got], dtype=np.float64).reshape(-1, len(NAMES))
    return train(x, np.array([b for _, b in got], dtype=np.float64), learn_lexicon(sample.df))


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``score``, the probability that a text is toxic (0 to 1).

    Null and empty texts have no hits and all rates zero, and get the score of
    that point. A ``score`` column of the input is replaced. Repeated rows get
    equal scores; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[list]:
        return [shared.value.scores(texts).tolist()]

    return with_text_results(docs, text_col, {"score": ("double", pa.float64())}, run, keep)
