"""Soft-membership mixing: how often to take each document so that domains meet their token targets.

1. A labelled table (document, domain) trains a naive Bayes model on hashed words and sign runs, and on how long and
   how repetitive a text is. For each bucket and domain the evidence is the log of the domain's share among documents
   with that bucket over its share overall, with `SMOOTHING` documents of the overall mix added. Only telling buckets
   count: those `STRONG` times as frequent in a domain as in the other domains together (a ratio without a ceiling, also
   for a domain that most documents have), by more than `SIGNIFICANT` standard deviations; common words, each a little
   rarer in one domain, are not independent and must not outvote a telling one. A telling bucket that a document lacks
   is evidence too. The model is buckets x domains numbers, whatever the corpus.
2. Each document gets posteriors p over the domains.
3. Rates x >= 0 minimise r' H r, with residuals r = sum x t p - target over the domains, t being tokens, and the weights
   H the inverse of sum t p p', by projected gradient descent with momentum and steps scaled by 1 / t. With these weights one step
   removes all of r that bounds do not hold back. The descent's state is one number per domain and step: the rate after
   k steps is a fold of those numbers over the document's own p, so each step is one aggregate over (t, p) and nothing
   is rewritten.
4. A document is taken floor(x) times, and once more with probability x - floor(x), drawn from its id.

DataFrame expressions only; what the driver holds is the model and one number per domain and step.

Defined cases: null texts have no tokens, the overall shares as posteriors, and a rate of their own; labels with a null
document or domain, of an unknown document, or of a domain without target are left out; a document labelled twice counts
twice; repeated documents are rated each; without any labels the posteriors are equal; an empty table gives no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Collection
from math import log
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import stored, text_or_empty

BUCKETS = 65536
#: Labelled documents, those with the least hash of their id, from which the model is fitted: a bound for what is sent
#: to every task.
LABELLED = 40_000
SMOOTHING = 1.0
SIGNIFICANT, STRONG = 4.0, 3.0
#: Steps after which the descent is given up: its stop test holds long before, or its result is no mixture.
STEPS = 600
#: Largest miss of a target, as a share of all tokens, at which the descent ends.
TOLERANCE = 1e-5
#: Miss of a target, as a share of all wanted tokens, that is reported.
MISSED = 1e-3
_LOG = logging.getLogger(__name__)
#: Words (letters, marks and digits of any script) and runs of other signs; \s is ASCII only, \p{Z} has the other spaces.
_UNITS = r"[\p{L}\p{M}\p{N}]+|[^\s\p{Z}\p{L}\p{M}\p{N}]+"


class Mixture(NamedTuple):
    """`rows`: the input's rows with _tokens, _p (posteriors in the order of `domains`) and _rate; `totals`: expected
    tokens by domain before and after, and the targets."""
    rows: DataFrame
    domains: list[str]
    totals: dict[str, tuple[float, float, float]]


def _featured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    units = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(_UNITS), F.lit(0))
    featured = docs.select(*keep, units.alias("_units"))
    tokens, different = F.size("_units"), F.array_distinct("_units")
    form = F.array(F.concat(F.lit(" length "), F.floor(F.log2(tokens + F.lit(1.0)))),
                   F.concat(F.lit(" different "), F.floor(F.size(different) * 10 / F.greatest(tokens, F.lit(1)))))
    bucket = F.transform(F.concat(different, form), lambda u: F.pmod(F.xxhash64(u), F.lit(BUCKETS)).cast("int"))
    return featured.withColumns({"_tokens": tokens.cast("long"), "_buckets": F.array_distinct(bucket)}).drop("_units")


class _Model(NamedTuple):
    """Log odds of the domains for a document without telling buckets, and what each of these adds to them."""
    without: list[float]
    telling: list[bool]
    evidence: list[list[float]]


def _numbers(values: list[str]) -> Column:
    """A constant array, written compactly; folded to one literal before execution."""
    return F.split(F.lit(" ".join(values)), " ").cast("array<double>")


def _told(telling: list[bool]) -> Column:
    """The telling ones of a row's buckets."""
    flags = _numbers(["1" if t else "0" for t in telling])
    return F.filter("_buckets", lambda b: F.get(flags, b) > 0)


def _fit(featured: DataFrame, id_column: str, labels: DataFrame, domains: list[str]) -> _Model:
    known = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_labelled"), F.col("domain").alias("_domain"))
    known = known.orderBy(F.xxhash64(F.lit("labels"), "_labelled"), "_labelled", "_domain").limit(LABELLED)
    rows = featured.select(F.col(id_column).alias("_id"), "_buckets").join(
        F.broadcast(known), F.col("_id") == F.col("_labelled"))
    per_domain = [F.sum((F.col("_domain") == d).cast("long")) for d in domains]
    counts = rows.select("_domain", F.explode("_buckets").alias("_bucket")).groupBy("_bucket").agg(*per_domain)
    n = [float(c or 0) for c in rows.agg(*per_domain).first()]
    shares = [(c + 1.0) / (sum(n) + len(domains)) for c in n]
    without = [log(share) for share in shares]
    telling, evidence = [False] * BUCKETS, [[0.0] * BUCKETS for _ in domains]
    for bucket, *c in counts.collect():  # at most BUCKETS rows
        expected = [sum(c) * share for share in shares]
        likelier = [(o + SMOOTHING * s) / (e + SMOOTHING * s) for o, e, s in zip(c, expected, shares)]
        # How frequent among a domain's documents, against all others'.
        here = [(o + SMOOTHING * s) / (m + SMOOTHING) for o, s, m in zip(c, shares, n)]
        there = [(sum(c) - o + SMOOTHING * s) / (sum(n) - m + SMOOTHING) for o, s, m in zip(c, shares, n)]
        if any(h >= STRONG * t and o - e > SIGNIFICANT * (e * (1 - s) + 1) ** 0.5
               for h, t, o, e, s in zip(here, there, c, expected, shares)):
            telling[bucket] = True
            for k, r in enumerate(likelier):
                absent = log(1 - min(0.95, r * sum(c) / sum(n)))
                without[k] += absent
                evidence[k][bucket] = log(r) - absent
    return _Model(without, telling, evidence)


def _posteriors(model: _Model) -> tuple[Column, Column, Column]:
    """Expressions for log odds (of _told), their weights (of _scores), and posteriors (of _weights)."""
    def score(k: int) -> Column:
        weights = _numbers([f"{e:.5f}" if t else "0" for e, t in zip(model.evidence[k], model.telling)])
        return F.aggregate("_told", F.lit(model.without[k]), lambda s, b: s + F.get(weights, b))

    scores = F.array(*(score(k) for k in range(len(model.without))))
    # Against the best score: no overflow, and every term at most 1.
    best = F.array_max("_scores")
    weights = F.transform("_scores", lambda s: F.exp(F.greatest(s - best, F.lit(-60.0))))
    total = F.aggregate("_weights", F.lit(0.0), lambda a, w: a + w)
    return scores, weights, F.transform("_weights", lambda w: w / total)


def _rate(steps: list[list[float]], least: float, most: float | None, lowered: list[int]) -> Column:
    """The rate after the steps taken so far: from 1, minus p . q for each step's q, kept within the bounds.

    The last number of a step is its momentum: the next one starts that much further on. The lower bound shrinks with
    the share of the domains `lowered` in p.
    """
    floor = F.lit(float(least))
    if least > 0:
        for d in lowered:
            floor = floor - float(least) * F.get("_p", F.lit(d))
        floor = F.greatest(floor, F.lit(0.0))
    start = F.lit(float(max(least, 1.0 if most is None else min(1.0, most))))
    if not steps:
        return start

    def step(at: Column, q: Column) -> Column:
        new = at["ahead"]
        for d in range(len(steps[0]) - 1):
            new = new - F.get("_p", F.lit(d)) * F.get(q, F.lit(d))
        new = F.greatest(new, floor)
        new = new if most is None else F.least(new, F.lit(float(most)))
        ahead = new + F.get(q, F.lit(len(steps[0]) - 1)) * (new - at["rate"])
        return F.struct(new.alias("rate"), ahead.alias("ahead"))

    begin = F.struct(start.alias("rate"), start.alias("ahead"))
    taken = F.array(*(_numbers([repr(v) for v in q]) for q in steps))
    return F.aggregate(taken, begin, step, lambda at: at["rate"])


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_column: str = "doc_id",
                   text: str = "text", total: float = 1.0, least: float = 0.0, most: float | None = None,
                   keep: list[str] | None = None, lowered: Collection[str] = ()) -> Mixture:
    """Rates such that domain d has about `targets[d]` of `total` times the input's tokens.

    `labels` holds doc_id and domain; targets are normalised to sum 1. `least` and `most` bound the rates; a
    document of a domain in `lowered` may be taken less often, down to 0, in proportion to its posterior. `keep` names
    the columns to return, all by default (the id has to be among them). A target that the bounds keep out of reach is
    logged as a warning; `totals` has the figures.
    """
    if not targets or min(targets.values()) < 0 or not sum(targets.values()):
        raise ValueError("targets are nonnegative, with a positive sum")
    domains = sorted(targets)
    low = [k for k, d in enumerate(domains) if d in lowered]
    featured = stored(_featured(docs, text, keep or docs.columns), "mix-features")
    model = _fit(featured, id_column, labels, domains)
    scores, weights, posterior = _posteriors(model)

    def with_p(rows: DataFrame) -> DataFrame:
        for name, column in (("_told", _told(model.telling)), ("_scores", scores), ("_weights", weights), ("_p", posterior)):
            rows = rows.withColumn(name, column)
        return rows.drop("_told", "_scores", "_weights")

    light = stored(with_p(featured.select("_tokens", "_buckets")).select("_tokens", "_p"), "mix-posteriors")
    k = range(len(domains))

    def sums(steps: list[list[float]]) -> list[float]:
        used = F.col("_tokens") * _rate(steps, least, most, low)
        return [v or 0.0 for v in light.agg(*(F.sum(used * F.get("_p", F.lit(d))) for d in k)).first()]

    taken = [F.col("_tokens") * F.get("_p", F.lit(d)) for d in k]
    sums_ = light.agg(*(F.sum(c) for c in taken), *(F.sum(c * F.get("_p", F.lit(e))) for c in taken for e in k)).first()
    now = [v or 0.0 for v in sums_[:len(domains)]]
    weight = np.linalg.pinv(np.array([v or 0.0 for v in sums_[len(domains):]]).reshape(len(domains), -1))
    goal = [sum(now) * total * targets[d] / sum(targets.values()) for d in domains]
    steps: list[list[float]] = []
    reached = before = np.array(sums(steps))
    momentum, speed = 0.0, 1.0
    while True:
        if np.abs(reached - goal).max() <= TOLERANCE * max(sum(now), 1.0):
            break
        if len(steps) == STEPS:
            raise RuntimeError(f"the mixture does not settle within {STEPS} steps: reached {reached.tolist()}, wanted {goal}")
        # What the point ahead reaches follows from the last two: sums are linear in the rates.
        ahead = reached + momentum * (reached - before)
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        momentum, speed = (speed - 1) / faster, faster
        steps.append([*(weight @ (ahead - goal)).tolist(), momentum])
        before, reached = reached, np.array(sums(steps))
        miss, last = (float((at - goal) @ weight @ (at - goal)) for at in (reached, before))
        if miss > last:  # momentum has carried the rates too far: the next step starts from where they are
            steps[-1][-1], momentum, speed = 0.0, 0.0, 1.0
        if np.abs(reached - before).max() <= TOLERANCE * 0.01 * max(sum(now), 1.0):
            break  # the bounds leave nothing to gain
    rows = with_p(featured).drop("_buckets").withColumn("_rate", _rate(steps, least, most, low))
    missed = {d: (round(r), round(g)) for d, r, g in zip(domains, reached.tolist(), goal)
              if abs(r - g) > MISSED * max(sum(goal), 1.0)}
    if missed:
        _LOG.warning("mixture misses its targets, tokens (reached, wanted): %s", missed)
    return Mixture(rows, domains, {d: (now[i], float(reached[i]), goal[i]) for i, d in enumerate(domains)})


def copies(rate: Column, key: Column, seed: int = 0) -> Column:
    """How often a document is taken: its rate, rounded up or down by a draw from its key."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / F.lit(float(2 ** 53))
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")
