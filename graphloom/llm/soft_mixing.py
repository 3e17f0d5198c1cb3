"""Mixing to target weights with soft domain membership.

A naive Bayes classifier over binned text statistics, learnt from a labelled
table, gives each document a posterior over domains. The bins' edges are
quantiles of the labelled documents. Document rates r >= 0 are then fitted so
that the expected domain token totals, sum over documents of tokens *
posterior * rate, match the targets: least squares by projected gradient steps
from r = 1, each preconditioned by the (domains x domains) normal matrix of the
rows whose rate is not at zero, whatever the number of domains. A step changes a document's rate by the same
linear function of its posterior everywhere, so the rates never need to be
stored: they follow from the posterior and the list of steps, and each step is
one aggregate over a narrow table. Only DataFrame operations run on rows.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.staging import Staged, packed, unpacked
from graphloom.llm.text_stats import CHANCES, once

#: Rates of text that are binned; ``signals`` is the number of distinct words learnt for any domain.
STATISTICS = ["upper", "symbols", "marks", "distinct", "length", "signals"]
#: The labelled documents' quantiles that are the bins' upper ends.
QUANTILES = [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98]
MAX_SIGNALS = 500
#: Domains up to which one row of sums holds the normal matrix; for more it is summed row by row, to the same end.
ONE_ROW = 16


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[\s\p{Punct}]+"))


def _statistics(text: Column, signals: list[str]) -> list[Column]:
    """``tokens`` (words between white space) and STATISTICS, over the whole text."""
    size, tokens = F.greatest(F.length(text), F.lit(1)), F.regexp_count(text, F.lit(r"\S+"))
    words = _words(text)
    hits = F.size(F.array_intersect(words, F.array(*map(F.lit, signals)))) if signals else F.lit(0)
    rate = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    return [
        tokens.cast("long").alias("tokens"),
        rate(r"\p{Lu}").alias("upper"),
        rate(r"[^\p{L}\p{N}\s.,;:!?'\"()-]").alias("symbols"),
        rate(r"[!?]").alias("marks"),
        (F.size(words) / F.greatest(tokens, F.lit(1))).alias("distinct"),
        F.length(text).cast("double").alias("length"),
        hits.cast("double").alias("signals"),
    ]


def _bin(name: str, edges: list[float]) -> Column:
    """The number of edges below the value."""
    return sum(((F.col(name) > edge).cast("int") for edge in edges), F.lit(0))


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


@dataclass
class Model:
    domains: list[str]
    signals: list[str]
    log_prior: list[float]
    edges: dict[str, list[float]]
    log_given: dict[str, list[list[float]]]  # statistic: domain x bin

    def posterior(self) -> Column:
        """The domains' probabilities as an array, from the columns of STATISTICS."""
        logs = _numbers(self.log_prior)
        for name, edges in self.edges.items():
            by_bin = F.array(*[_numbers(column) for column in zip(*self.log_given[name])])
            logs = F.zip_with(logs, F.element_at(by_bin, _bin(name, edges) + 1), lambda a, b: a + b)
        powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
        return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _signals(sample: DataFrame, least: int, odds: float) -> list[str]:
    """Words that at least ``least`` texts of a domain have, and exp(odds) times as often as texts of all others; at most MAX_SIGNALS."""
    sizes = {r["_domain"]: r["count"] for r in sample.groupBy("_domain").count().collect()}
    if len(sizes) < 2:
        return []
    total = sum(sizes.values())
    words = sample.select("_domain", F.explode(_words(F.col("_text"))).alias("word")).filter("length(word) BETWEEN 2 AND 40")
    counts = words.groupBy("word", "_domain").count()
    with_all = counts.groupBy("word").agg(F.sum("count").alias("all"), F.max(F.struct("count", "_domain")).alias("top"))
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    own, n = F.col("top.count"), size[F.col("top._domain")]
    ratio = F.log((own + 0.5) / (n + 1)) - F.log((F.col("all") - own + 0.5) / (total - n + 1))
    kept = with_all.filter(own >= least).withColumn("odds", ratio).filter(F.col("odds") >= odds).orderBy(F.desc(F.col("odds") * own), "word").limit(MAX_SIGNALS)
    return sorted(r["word"] for r in kept.collect())


def fit(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", bound: int = 20_000, least: int = 8, odds: float = 4.5) -> Model:
    """A classifier from about ``bound`` documents of ``labelled`` (identifier, domain), chosen by hash.

    A document labelled more than once counts with its greatest domain name,
    rows that repeat an identifier count once. Rows without identifier or
    domain take no part. Without labels there is one domain named ``all``.
    """
    said = labelled.filter(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(domain_col).alias("_domain"))
    share = min(1.0, bound / max(1, said.count()))
    chosen = said.filter(F.pmod(F.xxhash64(F.lit(13), "_id"), F.lit(CHANCES)) < share * CHANCES)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # about ``bound`` identifiers are broadcast
    sample = Staged(once(docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(chosen), "_id"), "_domain"), "labelled")
    signals = _signals(sample.df, least, odds)
    stats = Staged(sample.df.select("_domain", *_statistics(F.col("_text"), signals)), "statistics")
    found = stats.df.agg(*[F.percentile_approx(name, QUANTILES, 1000).alias(name) for name in STATISTICS]).first()
    edges = {name: sorted(set(found[name] or [])) for name in STATISTICS}
    counts = [F.sum((_bin(name, edges[name]) == b).cast("long")).alias(f"{name}_{b}") for name in STATISTICS for b in range(len(edges[name]) + 1)]
    rows = sorted(stats.df.groupBy("_domain").agg(F.count("*").alias("_n"), *counts).collect(), key=lambda r: r["_domain"])
    sample.drop()
    stats.drop()
    if not rows:
        return Model(["all"], [], [0.0], {}, {})
    total = sum(r["_n"] for r in rows)
    given = {name: [[math.log((r[f"{name}_{b}"] + 0.1) / (r["_n"] + 0.1 * (len(ends) + 1))) for b in range(len(ends) + 1)] for r in rows] for name, ends in edges.items()}
    return Model([r["_domain"] for r in rows], signals, [math.log(r["_n"] / total) for r in rows], edges, given)


@dataclass
class Fit:
    steps: list[list[float]]  # of each step, what it takes off a rate for each domain
    totals: list[float]  # expected domain tokens at the fitted rates
    before: list[float]  # and at rates of 1
    targets: list[float]
    error: float = 0.0  # largest miss of a target, as a share of the budget
    converged: bool = True

    def rate(self) -> Column:
        """A document's rate, from its posterior ``p``."""
        start = F.lit(1.0)
        if not self.steps:
            return start
        taken = lambda s: F.aggregate(F.zip_with("p", s, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.aggregate(F.array(*map(_numbers, self.steps)), start, lambda r, s: F.greatest(F.lit(0.0), r - taken(s)))


def fit_rates(posteriors: DataFrame, k: int, weights: list[float], *, budget=None, rounds: int = 40, tolerance: float = 1e-7) -> Fit:
    """Rates for ``posteriors`` (tokens, p) that give domain i ``weights[i]`` of the budget.

    ``budget``: a number of tokens, a function of the totals at rates of 1, or
    None for the sum of these totals. A domain without any expected token is
    left out, as no rate can change it. Where no domain has a weight, or there
    are no tokens, all rates stay 1. Of all rounds the best is returned; if its
    error is over ``tolerance``, ``converged`` is false and a warning is given:
    the targets are then as near as the posteriors and the rounds allow.
    """
    share = np.array(weights, dtype=float)
    if (share < 0).any() or not np.isfinite(share).all():
        raise ValueError("weights must be finite and not negative")
    p = [F.col("p")[i] for i in range(k)]
    before = np.array([x or 0.0 for x in posteriors.agg(*[F.sum(F.col("tokens") * x) for x in p]).first()])
    whole = before.sum() if budget is None else budget(before) if callable(budget) else budget
    if not share.sum() or not before.sum():
        return Fit([], before.tolist(), before.tolist(), before.tolist())
    targets = share / share.sum() * whole
    best = Fit([], before.tolist(), before.tolist(), targets.tolist(), math.inf, False)
    least, damp, fails, steps = math.inf, 1.0, 0, []
    use, bound, direction, miss = before > 0, None, np.zeros(k), np.zeros(k)
    for _ in range(rounds):
        tried = Fit(list(steps), [], before.tolist(), targets.tolist())
        moving = F.col("tokens") * (F.col("_r") > 0).cast("double")
        rated = posteriors.withColumn("_r", tried.rate())
        normal = [F.sum(moving * p[i] * p[j]) for i in range(k) for j in range(i + 1)] if k <= ONE_ROW else []
        row = [x or 0.0 for x in rated.agg(*[F.sum(F.col("tokens") * x * F.col("_r")) for x in p], *normal).first()]
        missed = np.where(use, np.array(row[:k]) - targets, 0.0)
        tried.totals, tried.error = row[:k], float(np.abs(missed).max() / max(whole, 1e-9))
        tried.converged = tried.error <= tolerance
        square = float(missed @ missed)
        if square < least:
            best, least, miss, fails = tried, square, missed, 0
            if best.converged:
                return best
            damp = min(1.0, damp * 1.5)
            m = np.zeros((k, k))
            if normal:
                m[np.tril_indices(k)] = row[k:]
                m = m + np.tril(m, -1).T
            else:
                each = rated.select(moving.alias("_w"), "p", F.posexplode("p").alias("_i", "_p")).groupBy("_i").agg(*[F.sum(F.col("_w") * F.col("_p") * x) for x in p])
                for i, *sums in each.collect():  # a row for each domain
                    m[i] = [x or 0.0 for x in sums]
            bound = bound or np.linalg.eigvalsh(m)[-1]
            direction = np.linalg.solve(m + 1e-6 * (np.trace(m) / k + 1e-9) * np.eye(k), miss)
        else:
            fails, damp = fails + 1, damp / 3
        # a step of the plain gradient by the inverse of the largest eigenvalue never fails
        steps = [*best.steps, [float(x) for x in (miss / bound if fails > 1 else damp * direction)]]
    warnings.warn(f"mixing: targets missed by {best.error:.2g} of the budget after {rounds} rounds", stacklevel=2)
    return best


def document_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", budget=None, bound: int = 20_000, seed: int = 31) -> DataFrame:
    """One row for each row of ``docs``: id, tokens, domain, posterior (map), rate, copies.

    ``weights`` gives the domains' shares of the tokens; one that is missing
    there gets 0. ``copies`` rounds the rate up or down by a hash of the
    identifier, up in proportion to its fraction, so expected totals hold.
    Without labels, or if no learnt domain has a weight, all rates are 1. Null and empty texts have no tokens and the posterior of a text whose
    statistics are all zero. Repeated rows get equal values. An empty table
    gives an empty one.
    """
    model = fit(docs, labelled, id_col=id_col, text_col=text_col, domain_col=domain_col, bound=bound)
    scored = Staged(_scored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model), "posteriors")
    fitted = fit_rates(scored.df, len(model.domains), [weights.get(x, 0.0) for x in model.domains], budget=_by_name(budget, model))
    return _with_copies(scored.df, fitted, seed).select(
        F.col("_id").alias(id_col),
        "tokens",
        F.element_at(F.array(*map(F.lit, model.domains)), F.array_position("p", F.array_max("p")).cast("int")).alias("domain"),
        F.map_from_arrays(F.array(*map(F.lit, model.domains)), "p").alias("posterior"),
        "rate",
        "copies",
    )


def _by_name(budget, model: Model):
    return (lambda totals: budget(dict(zip(model.domains, map(float, totals))))) if callable(budget) else budget


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with ``_text``) with tokens and posterior ``p`` instead of the text."""
    rest = [c for c in rows.columns if c != "_text"]
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    return rows.select(*rest, *_statistics(text, model.signals)).select(*rest, "tokens", model.posterior().alias("p"))


def _with_copies(scored: DataFrame, fitted: Fit, seed: int) -> DataFrame:
    even = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) / float(1 << 30)
    rated = scored.withColumn("rate", F.round(fitted.rate(), 6))
    # the row number keeps conditions on ``copies`` from being pushed below, which would repeat all of its work
    return rated.withColumns({"copies": (F.floor("rate") + (even < F.col("rate") - F.floor("rate")).cast("long")).cast("long"), "_row": F.monotonically_increasing_id()})


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", budget=None, bound: int = 20_000, seed: int = 31) -> DataFrame:
    """The rows of ``docs`` as often as their ``copies`` (see ``document_rates``) say, with all their columns.

    Columns may have any names. ``budget`` as a function gets the totals by
    domain name. Rows without identifier are rounded alike; repeated rows are
    copied alike; an empty table gives an empty one.
    """
    model = fit(docs, labelled, id_col=id_col, text_col=text_col, domain_col=domain_col, bound=bound)
    scored = Staged(_scored(docs.select(F.col(text_col).alias("_text")), model), "posteriors")
    fitted = fit_rates(scored.df, len(model.domains), [weights.get(x, 0.0) for x in model.domains], budget=_by_name(budget, model))
    scored.drop()
    wide = _scored(docs.select(packed(docs), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model)
    return _with_copies(wide, fitted, seed).select("_doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*unpacked(docs.columns))
