"""Document quality by regularised quadratic discriminant analysis.

Statistics of a document are transformed to be roughly normal. Each class has
a mean and a covariance, shrunk towards the pooled covariance and a multiple
of the identity. A document's score comes from the difference of the two
log-densities, computed as Mahalanobis distances with Cholesky factors that
are made once and sent with the model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.functions.ship import ship
from graphloom.llm.rows import AT_ONCE, with_text_results
from graphloom.llm.text_stats import labelled_sample

NAMES = ["log_chars", "upper", "digits", "symbols", "bars", "marks", "newlines", "word_length", "distinct_words", "repeated_words", "repeated_lines", "long_words", "compression"]
_SYMBOLS = re.compile(rb"[#$%&*@^~=+<>_\\{}\[\]]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(rb"[0-9]")
_MARKS = re.compile(rb"[!?]")


def statistics(text: str | None) -> list[float]:
    """The untransformed statistics, over the whole text; zeros for an empty one."""
    text = text or ""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "replace")
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    upper = len(_UPPER.findall(text))
    return [
        np.log1p(n),
        upper / n,
        len(_DIGITS.findall(raw)) / n,
        len(_SYMBOLS.findall(raw)) / n,
        raw.count(b"|") / n,
        len(_MARKS.findall(raw)) / n,
        raw.count(b"\n") / n,
        (n - text.count(" ")) / k,
        len(set(words)) / k,
        sum(map(str.__eq__, words, words[1:])) / k,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) > 25 for w in words) / k,
        _packed_share(raw),
    ]


def _packed_share(raw: bytes, block: int = 1 << 16) -> float:
    return sum(len(zlib.compress(raw[at : at + block], 1)) for at in range(0, len(raw), block)) / len(raw)


_RATES = np.array([name in ("upper", "digits", "symbols", "bars", "marks", "newlines", "repeated_words", "repeated_lines", "long_words") for name in NAMES])


def transform(x: np.ndarray) -> np.ndarray:
    """Square roots of rates; all else as it is."""
    return np.where(_RATES, np.sqrt(np.maximum(x, 0)), x)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # classes x statistics
    factors: np.ndarray  # Cholesky factors of the inverse covariances
    offsets: np.ndarray  # log priors less half the log determinants
    slope: float  # of the calibration
    shift: float

    def margins(self, raw: np.ndarray) -> np.ndarray:
        z = (transform(raw) - self.centre) / self.scale
        density = [o - 0.5 * (((z - m) @ f) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return density[1] - density[0]

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(raw) + self.shift, -500, 500)))


def train(raw: np.ndarray, y: np.ndarray, *, to_pooled: float = 0.3, to_identity: float = 0.02) -> Model:
    """``to_pooled`` and ``to_identity``: the shares of the pooled covariance and of the mean variance times identity."""
    x = transform(raw)
    d = x.shape[1]
    centre = x.mean(axis=0) if len(x) else np.zeros(d)
    scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(d)
    z = (x - centre) / scale
    groups = [z[y == c] for c in (0, 1)]
    means = np.array([g.mean(axis=0) if len(g) else np.zeros(d) for g in groups])
    scatters = [(g - m).T @ (g - m) for g, m in zip(groups, means)]
    pooled = sum(scatters) / max(1, len(z)) + 1e-9 * np.eye(d)
    factors, offsets = [], []
    for g, s in zip(groups, scatters):
        own = s / len(g) if len(g) > 1 else pooled
        cov = (1 - to_pooled) * own + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low).T)
        offsets.append(np.log((len(g) + 1) / (len(z) + 2)) - np.log(np.diag(low)).sum())
    model = Model(centre, scale, means, np.array(factors), np.array(offsets), 1.0, 0.0)
    if min(map(len, groups)) > 1:
        model.slope, model.shift = _calibration(model.margins(raw), y)
    return model


def _calibration(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the margins, by Newton steps with a small penalty towards 1 and 0."""
    m = np.clip(margin, -50, 50)
    a, b = 0.1, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * m).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -2, 2)
    return max(float(a), 1e-3), float(b)


def collect_statistics(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and labels of a bounded ``labelled_sample``, in an order that depends on nothing but the rows."""
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                x = [statistics(t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    got = sample.select("_label", "_text").mapInArrow(run, "label int, x array<double>").collect()
    got = sorted((list(r["x"]), r["label"]) for r in got)
    return np.array([x for x, _ in got], dtype=np.float64).reshape(-1, len(NAMES)), np.array([c for _, c in got], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = 20_000) -> Model:
    """A model from about ``bound`` labelled documents at most; only their statistics reach the driver."""
    return train(*collect_statistics(labelled_sample(docs, labels, label_col, bound, id_col=id_col, text_col=text_col)))


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``score``, the probability of class 1 (0 to 1).

    Null and empty texts have all statistics zero and get the score of that
    point. A ``score`` column of the input is replaced. Repeated rows get
    equal scores; an empty table gives an empty one. Without labels of both
    classes the score is the same for all texts but for the densities' noise.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[list]:
        return [shared.value.scores(np.array([statistics(x) for x in texts])).tolist()]

    return with_text_results(docs, text_col, {"score": ("double", pa.float64())}, run, keep)
